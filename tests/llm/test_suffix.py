"""Suffix sorting against plain sorting, and removal of repeated strings against a dictionary of all strings."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from braidvec.llm import suffix


def brute(rows):
    seen, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for k in range(len(t) - suffix.SPAN + 1):
            w = t[k : k + suffix.SPAN]
            seen[w] = min(seen.get(w, (d, k)), (d, k))
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - suffix.SPAN + 1):
            if seen[t[k : k + suffix.SPAN]] != (d, k):
                gone[k : k + suffix.SPAN] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("letters,length", [(2, 400), (3, 700), (20, 500), (1, 300)])
def test_two_stage_sort_orders_like_plain_sorting(letters, length):
    rng = np.random.default_rng(letters)
    data = np.concatenate([rng.integers(97, 97 + letters, length).astype(np.uint8), np.zeros(150, np.uint8)])
    wanted = np.sort(rng.choice(length, length // 2, replace=False))
    got = suffix.two_stage_sort(data, wanted)
    assert sorted(got) == sorted(wanted)
    raw = data.tobytes()
    keys = [raw[k : k + suffix.SPAN] for k in got]
    assert keys == sorted(keys)
    assert list(suffix.same_prefix(data, got)) == [a == b for a, b in zip(keys, keys[1:], strict=False)]


def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(40), "Licensed under the usual license, version 2.0, by all."
    rows = [(k, prose(60)) for k in range(12)]
    rows += [(20 + k, f"{prose(20)} {shared} {prose(20)}") for k in range(8)]
    rows += [(40 + k, rows[k % 3][1]) for k in range(9)]
    rows += [(60 + k, f"{prose(12)}\n{line}\n{prose(12)}") for k in range(12)]
    near = rows[5][1].split(" ")
    for k in range(6):
        changed = list(near)
        changed[8 * k + 3] = word()
        rows.append((80 + k, " ".join(changed)))
    rows += [(100, "ab " * 200), (101, "x" * 500), (102, ""), (103, None), (104, "é" * 120), (105, shared[:99]), (106, "short")]
    rows += [(107, f"{shared} {prose(5)} {shared}"), (7, rows[7][1]), (-4, rows[9][1][:150])]
    return rows


@pytest.mark.parametrize("hot", [suffix.HOT_SEGMENTS, 2])
def test_removal_matches_a_dictionary_of_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as n_bytes", "'x' as kept")
    got = sorted(tuple(r) for r in suffix.remove_repeats(docs).collect())
    assert got == brute(rows)


def test_long_documents_are_cut_into_overlapping_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 105, 5000).astype(np.uint8)
    text[3000:3400] = text[100:500]
    monkeypatch.setattr(suffix, "BLOCK", 700)
    covered = np.zeros(5000, int)
    for block, cuts, _, shift in suffix._blocks_of(text, np.array([0, 5000])):
        owner, first, count, _, _ = suffix.segments(block, cuts)
        for a, n in zip(first - cuts[owner] + shift[owner], count, strict=True):
            covered[a : a + n] += 1
    assert (covered[: 5000 - suffix.SPAN + 1] == 1).all() and covered[5000 - suffix.SPAN + 1 :].sum() == 0


def test_empty_table_and_missing_ids(spark):
    schema = "doc_id long, text string"
    assert suffix.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "the quick brown fox " * 3 + "jumps over the lazy dog again and again until evening comes"
    rows = [(None, long), (1, long)]
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: 0, 1: len(long)}


def test_requested_text_leaves_as_one_row_a_part_whatever_the_documents():
    rng = np.random.default_rng(9)
    rows, asked = [], {}
    for doc in range(60):
        own = rng.integers(97, 123, 900).astype(np.uint8)
        owner, first, count, anchor, _ = suffix.segments(own, np.array([0, len(own)]))
        one = lambda x, t: x.astype(t).tobytes()
        kinds = np.arange(len(first)) % 2 == 0
        wants = [
            {"kind": kind, "anchor": one(anchor[some], np.uint64), "first": one(first[some], np.int32), "count": one(count[some], np.uint8)}
            for kind, some in ((suffix._REQUEST, kinds), (suffix._WINDOW, ~kinds))
        ]
        rows.append({"doc_id": doc, "text": own.tobytes().decode(), "asked": wants})
        asked |= {(doc, int(a), int(n)): own[a : a + n + suffix.SPAN - 1].tobytes() for a, n in zip(first[kinds], count[kinds], strict=True)}
        asked |= {(doc, int(a) + k, 1): None for a, n in zip(first[~kinds], count[~kinds], strict=True) for k in range(int(n))}
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    sent = pa.Table.from_batches(list(suffix._send_text(12)(iter(batches)))).to_pylist()
    assert len(sent) <= 2 * 12  # documents times parts before
    several = pa.Table.from_batches(list(suffix._send_text(12, 20_000)(iter(batches)))).to_pylist()
    assert len(several) > len(sent)
    for found in (sent, several):
        got = {}
        for row in found:
            ids = (np.frombuffer(row[c], t) for c, t in (("doc", np.int64), ("first", np.int32), ("count", np.uint8)))
            at = 0
            for doc, first, count in zip(*(x.tolist() for x in ids), strict=True):
                size = count + suffix.SPAN - 1 if row["kind"] == suffix._REQUEST else 16
                got[doc, first, count] = row["bytes"][at : at + size] if row["kind"] == suffix._REQUEST else None
                at += size
            assert at == len(row["bytes"])
        assert got == asked
