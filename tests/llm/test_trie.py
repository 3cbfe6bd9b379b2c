"""The conversation trie against nested dictionaries of whole prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from braidvec.llm import trie

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            held[conv].append(((turn is not None, turn or 0), role.encode(), key, (role, text)))
    return {c: [r[-1] for r in sorted(v)] for c, v in held.items()}


def rebuild(held):
    out = {}
    for c in held:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + held[c][h:]
    return out


def plain_trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += own
    out = []
    for node, m in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_rows(seed, conversations, longest, texts):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "", None]
    rows = []
    for k in range(conversations):
        c = int(rng.integers(0, 900))
        for t in range(int(rng.integers(1, longest + 1))):
            rows.append((c, None if rng.random() < 0.05 else t, roles[t % 2 if rng.random() < 0.9 else rng.integers(5)], texts[rng.integers(len(texts))]))
    return rows + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("seed,longest", [(1, 4), (2, 9), (3, 30)])
def test_trie_matches_plain_prefixes(spark, seed, longest):
    rows = random_rows(seed, 250, longest, ["a", "bb", "\U0001f600é", None, ""])
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as size", "3 as pos", "4 as depth").repartition(3)
    held = ordered(rows)
    keys = trie.turn_keys(frame).persist()
    assert found(trie.conversation_trie(frame, rebuilt=True)) == plain_trie(rebuild(held))
    assert found(trie.conversation_trie(frame)) == plain_trie(held)
    # Paths of many segments and shards of few nodes give the same.
    assert found(trie.prefix_trie(trie.rebuilt_paths(keys, segment=5), shard_nodes=50)) == plain_trie(rebuild(held))
    assert found(trie.prefix_trie(trie.whole_paths(keys, segment=2), shard_nodes=50)) == plain_trie(held)


def test_query_matches_plain_prefixes(spark):
    from braidvec.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert found(QUERIES["op11_conversation_trie"](spark, SMALL)) == plain_trie(rebuild(ordered(rows)))


def test_many_children_and_many_copies(spark):
    rows = [(c, 0, "user", "same") for c in range(3000)] + [(c, 1, "assistant", f"own {c}") for c in range(0, 3000, 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.conversation_trie(frame)) == plain_trie(ordered(rows))


def test_missing_bases_and_turnless_conversations(spark):
    rows = [(c, 0, "user", "hi") for c in range(1, 60)] + [(100, 0, "user", "base"), (100, 1, "assistant", "two")] + [(c, t, "user", str(t)) for c in range(101, 140) for t in range(7)]
    held = rebuild(ordered(rows))
    assert any(not v for v in held.values())
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), rebuilt=True)) == plain_trie(held)


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA), rebuilt=True).count() == 0


def test_slot_table_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    d0, d1 = (rng.integers(0, 2**63, 50_000).astype(np.uint64) for _ in range(2))
    d0[:100] = 7  # equal halves
    table = trie.SlotTable(d0, d1)
    slots = table.slots(d0, d1)
    assert sorted(slots.tolist()) == list(range(50_000))
    assert (table.slots(d0, d1 ^ np.uint64(1)) == -1).all()
    assert len(trie.SlotTable(d0[:0], d1[:0])) == 0


def test_one_digest_for_two_prefixes_raises():
    rows = {c: np.array([1, 1], np.uint64 if c in ("d0", "d1", "p0", "p1", "check") else np.int64) for c in trie._NODE_COLUMNS}
    rows["check"] = np.array([1, 2], np.uint64)
    with pytest.raises(ValueError):
        trie.merge_nodes(rows)
