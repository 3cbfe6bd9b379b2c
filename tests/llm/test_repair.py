"""Conversation repair against a plain search over all edits, on both ways."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from braidvec.llm import repair

SMALL = "/root/testdata/sf0.001"
SOUND = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_report(rows):
    """Faults and the cheapest edits of one conversation, by trying every edit at every row from every state of the pattern."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    blank = duplicate = truncated = 0
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
        seen.add((role, text))
        faults.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    step = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}  # state: what the last turn was

    @lru_cache(None)
    def best(k, state, inserted):
        found = [(0, "")] if k == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for i in "ua":
                if state in step[i]:
                    cost, audit = best(k, step[i][state], inserted + 1)
                    found.append((cost + 5, "I" + audit))
        if k < len(rows):
            cost, audit = best(k + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if faults[k] not in ("b", "d"):
                extra = 5 * (faults[k] == "t")
                for i, price, letter in [(rows[k][1][:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")]:
                    if i in step and state in step[i]:
                        cost, audit = best(k + 1, step[i][state], 0)
                        found.append((cost + price + extra, letter + audit))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    k, repaired, want = 0, [], "u"
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role, text = ({"u": "user", "a": "assistant"}[want], "") if edit == "I" else (rows[k][1] if edit == "K" else {"u": "user", "a": "assistant"}[want], rows[k][2])
        k += edit != "I"
        repaired.append((role, text))
        want = "u" if role[:1] in ("s", "a") else "a"
    assert SOUND.fullmatch("".join(r[:1] for r, _ in repaired))
    lines = "\n".join(f"{r}:{x}" for r, x in repaired)
    return (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), repaired


def random_rows(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "user", "assistant", "Assistant", "ärger"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "One. Two", "a.\n", "¿qué?", " ", "x. \x1c"]
    return [
        (c, None if rng.random() < 0.1 else int(rng.integers(0, longest)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))])
        for c in range(conversations)
        for _ in range(rng.integers(0, longest + 1))
    ]


def compare(frame, rows, ids=None, **limits):
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(frame, ids, **limits).collect()}
    by_conv = {}
    for row in rows:
        if row[0] is not None:
            by_conv.setdefault(row[0], []).append(row)
    for key in [r.conv_id for r in ids.collect()] if ids is not None else []:
        by_conv.setdefault(key, [])
    assert set(got) == set(by_conv)
    for key, held in by_conv.items():
        assert got[key] == plain_report(held)[0], held
    return by_conv


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 7), (3, 12), (4, 40)])
def test_report_matches_plain_search(spark, seed, longest):
    rows = random_rows(seed, 120, longest)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as blank", "3 as pos", "true as gone").repartition(3)
    ids = spark.range(130).selectExpr("id as conv_id", "1 as turn")
    compare(frame, rows, ids)
    compare(frame, rows, ids, max_rows=5)  # long conversations by segments


def test_query_matches_plain_search(spark):
    from braidvec.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    want = {}
    for row in rows:
        want.setdefault(row[0], [])
    for row in plain_damage(rows):
        want[row[0]].append(row)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SMALL).collect()}
    assert got == {k: plain_report(v)[0] for k, v in want.items()}


def test_damage_of_nulls_and_repeats(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, 0, 1, 2, 3, 4) for r, x in [(None, None), ("user", "A. B? C!"), ("system", "A. B? C!")]]
    key = lambda row: tuple((v is not None, v if v is not None else 0) for v in row)
    got = sorted((tuple(r) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=key)
    assert got == sorted(plain_damage(rows), key=key)


def test_repaired_turns_on_both_ways(spark):
    rows = random_rows(9, 60, 20)
    frame = spark.createDataFrame(rows, SCHEMA)
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    want = sorted((k, p, *row) for k, v in by_conv.items() for p, row in enumerate(plain_report(v)[1]))
    for limit in (1000, 6):
        assert sorted(tuple(r) for r in repair.repaired_turns(frame, max_rows=limit).collect()) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(empty).count() == 0 and repair.repaired_turns(empty).count() == 0
    only = repair.repair_report(empty, spark.range(2).toDF("conv_id")).collect()
    assert sorted(tuple(r) for r in only) == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (0, 1)]


def test_split_of_a_span_does_not_matter():
    """Any split gives the cell that the whole chart finds."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 9, (200, 8))
    whole = repair.chart(kinds)
    for cut in range(1, 8):
        one = repair.combine(repair.chart(kinds[:, :cut]), repair.chart(kinds[:, cut:]))
        assert (one[0] == whole[0]).all() and (one[1] == whole[1]).all()
