"""Packing: every piece once, gapless places, few sequences, and the ids of the public tokenizer."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidvec.llm import binpack

SMALL = "/root/testdata/sf0.001"


def fewest(sizes, capacity):
    """Smallest number of sequences, by trying all places."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, bins[:i] + (bins[i] + sizes[k],) + bins[i + 1 :])
        place(k + 1, (*bins, sizes[k]))

    place(0, ())
    return best


def plain_best_fit(sizes, capacity):
    """One piece at a time: matching of the large ones, then best fit from the longest on."""
    large = sorted((s for s in sizes if s > capacity / 3), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), 0)
        if b:
            large.remove(b)
        gaps.append(capacity - a - b)
    for s in sorted((s for s in sizes if s <= capacity / 3), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def test_plan_equals_one_piece_at_a_time():
    rng = np.random.default_rng(4)
    for capacity, n in [(10, 40), (24, 60), (60, 300), (1, 5), (2, 9), (3, 20)]:
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, rng.integers(0, n)).tolist()
            plan = binpack.plan_sequences(np.bincount(sizes, minlength=capacity + 1), capacity)
            gaps = sorted(itertools.chain(*([capacity - sum(s * t for s, t in held)] * k for k, held in plan)))
            assert gaps == plain_best_fit(sizes, capacity)
            held = sorted(itertools.chain(*([s] * (t * k) for k, h in plan for s, t in h)))
            assert held == sorted(sizes) and all(g >= 0 for g in gaps)


def test_large_pieces_need_the_fewest_sequences():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(11, 31, 9).tolist()  # all above a third of 30
        plan = binpack.plan_sequences(np.bincount(sizes, minlength=31), 30)
        assert sum(k for k, _ in plan) == fewest(tuple(sorted(sizes, reverse=True)), 30)


def test_plan_does_not_grow_with_the_counts():
    counts = np.random.default_rng(6).integers(0, 10**9, 1025)
    counts[0] = 0
    plan = binpack.plan_sequences(counts, 1024)
    assert len(plan) < 5000 and sum(k * t for k, h in plan for _, t in h) == counts.sum()


def check(rows, texts, capacity, path=binpack.VOCABULARY):
    tokenizer = Tokenizer.from_file(path)
    whole = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    want = []
    for ids in whole:
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for at in held.values():
        at.sort()
        assert [o for o, _ in at] == [0, *itertools.accumulate(n for _, n in at[:-1])] and sum(n for _, n in at) <= capacity
    return len(held)


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    texts = [r.text for r in docs.select("text").collect()]
    rows = binpack.pack_documents(docs).collect()
    n = check(rows, texts, 1024)
    tokens = sum(r.length for r in rows)
    assert n <= 1.01 * -(-tokens // 1024) + 1


def test_odd_rows(spark):
    text = "".join(chr(c) for c in range(1, 0x3000) if not chr(c).isspace()) + " x" * 900
    odd = [(1, None), (1, None), (2, ""), (None, "words here"), (3, text), (4, "a <|endoftext|> b"), (5, "q" * 40_000), (5, "q" * 40_000), (6, " \n\t  ")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as rank", "2 as task", "3 as length", "4 as first")
    check(binpack.pack_documents(frame).collect(), [t for _, t in odd], 1024)
    check(binpack.pack_documents(frame, capacity=7).collect(), [t for _, t in odd], 7)
    empty = binpack.pack_documents(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    packed = binpack.pack_documents(docs, capacity=256, with_ids=True).persist()
    by_sequence = {r.sequence_id: r for r in binpack.sequences(packed).collect()}
    for r in packed.collect():
        assert by_sequence[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    assert sum(len(r.ids) for r in by_sequence.values()) == packed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("low", range(0, 0x110000, 0x40000))
def test_ids_equal_those_of_the_public_tokenizer_for_all_characters(low):
    tokenizer, encoding = Tokenizer.from_file(binpack.VOCABULARY), binpack._encoding(binpack.VOCABULARY)
    own = [chr(c) for c in range(low, min(low + 0x40000, 0x110000), 3) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a1{c}1 {c}!{c}!  x\n\n{c}{c} " for c in own]
    for text, found in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoding.encode(text, allowed_special="all") == found.ids
