"""Jaccard components against comparing every pair of sets."""

import re

import numpy as np
import pytest

from braidvec.llm import sigtree


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d, _ in rows)


def texts():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    rows, shared = [], prose(60)
    for group in range(14):
        base = prose(int(rng.integers(8, 160)))
        for copy in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(words) // 14))):
                words[int(rng.integers(0, len(words)))] = "x" + str(rng.integers(0, 10**6))
            rows.append((group * 100 + copy, (" " if copy % 2 else "\n").join(words)))
    base = prose(120)  # one large group of near copies, and chains in which only neighbours link
    for copy in range(70):
        words = list(base)
        for k in rng.integers(0, 120, 2):
            words[int(k)] = f"y{copy}{k}"
        rows.append((5000 + copy, " ".join(words)))
    chain = prose(200)
    for step in range(12):
        rows.append((7000 + step, " ".join(chain[8 * step : 8 * step + 100])))
    for k in range(12):
        rows.append((8000 + k, " ".join(prose(20) + shared + prose(25))))
    rows += [(9000, ""), (9001, None), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "one two three"), (9006, "one two three"), (9007, "a b c d e"), (9008, "a b c d e a b c d e a b c d e")]
    rows += [(9100 + k, rows[0][1].upper()) for k in range(5)] + [rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("chunk", [sigtree.CHUNK, 12])
def test_components_match_all_pairs(spark, chunk):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'z' as label").repartition(6)
    got = sorted(tuple(r) for r in sigtree.jaccard_components(docs, chunk=chunk).collect())
    assert got == brute(rows)


def test_kept_rows_and_columns(spark):
    rows = [(1, "a b c d e f g h", None), (2, "A b c d e f g h", "s"), (None, "a b c d e f g h", "t"), (3, "other words stand here alone now", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = sigtree.keep_first_of_components(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.label or "") for r in kept.collect()) == [(0, "t"), (1, ""), (3, "u")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sigtree.jaccard_components(empty).count() == 0


def test_tree_bound_never_drops_a_link():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 90).astype(np.uint64))
    sets = []
    for _ in range(60):
        s = base.copy() if rng.random() < 0.5 else np.unique(rng.integers(0, 1 << 62, int(rng.integers(60, 120))).astype(np.uint64))
        s[rng.integers(0, len(s), int(rng.integers(0, 12)))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(s))
    found = list(sigtree.link_chunk(np.arange(60), sets))
    forest, expect = sigtree.Forest(60), sigtree.Forest(60)
    for a, b in found:
        assert sigtree.linked(sets[a], sets[b])
        forest.join(a, b)
    for a in range(60):
        for b in range(a):
            if sigtree.linked(sets[a], sets[b]):
                expect.join(a, b)
    assert list(forest.labels()) == list(expect.labels())


@pytest.mark.parametrize("at_once", [sigtree.EDGES_AT_ONCE, 12])
def test_components_of_paths_stars_and_chains(spark, monkeypatch, at_once):
    monkeypatch.setattr(sigtree, "EDGES_AT_ONCE", at_once)  # the small bound needs distributed rounds
    pairs = [(k, k + 1) for k in range(30)] + [(100 + k, 150) for k in range(20)] + [(200, 201), (201, 202), (200, 202), (5, 5)]
    got = {r.node: r.label for r in sigtree.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys([*range(100, 120), 150], 100), **dict.fromkeys([200, 201, 202], 200)}


def links_of(rows):
    """Links of every row with all others, by comparing all pairs of rows."""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and d is not None else set())
    return [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("chunk, buckets", [(sigtree.LINK_CHUNK, sigtree.FILTER_BUCKETS), (12, 0)])
def test_links_match_all_pairs(spark, monkeypatch, chunk, buckets):
    monkeypatch.setattr(sigtree, "FILTER_BUCKETS", buckets)  # without the filter, candidates are found by a join
    rows = texts()
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as n", "'z' as label", "0 as members").repartition(6)
    got = sorted(tuple(r) for r in sigtree.jaccard_links(docs, chunk=chunk).filter("doc_id is not null").collect())
    plain = {d: (n, c) for d, n, c in brute(rows)}
    want = sorted((d, *plain[d], links) for (d, _), links in zip(rows, links_of(rows), strict=True))
    assert got == want
    assert sum(links for *_, links in got) > 3 * len(got)


def test_links_of_two_texts_under_one_id_and_of_an_empty_table(spark):
    rows = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k z"), (2, "a b c d e f g h i j k l m"), (3, None), (None, "a b c d e f g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in sigtree.jaccard_links(docs).collect())
    want = sorted((d or 0, len({tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)}), n) for (d, t), n in zip(rows, links_of(rows), strict=True))
    assert got == want
    assert sigtree.jaccard_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counted_overlaps_are_those_of_the_sets():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(rng.choice(pool, int(rng.integers(1, 250)))) for _ in range(150)]
    trees = [sigtree.Tree(sets[:70], 1024, 64), sigtree.Tree(sets[70:], 1024, 64)]
    overlaps = sigtree.Overlaps(trees)
    for inner, outer in ((range(0, 64), range(70, 134)), (range(64, 70), range(134, 150)), (range(0, 64), range(0, 64))):
        overlaps.hold(inner)
        assert overlaps.sizes(outer).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in outer] for i in inner]


def test_sets_of_other_sizes_are_not_in_one_window(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    chain, pools, sets = draw(241), {}, []
    for i in range(240):  # neighbours of the chain share a rare shingle and differ in size; four sets of one size share half of theirs
        quarters = pools.setdefault((i // 16, i % 4), [draw(4 << i % 4) for _ in range(4)])
        sets.append(np.unique(np.concatenate([*quarters[: i // 4 % 4], *quarters[i // 4 % 4 + 1 :], chain[i : i + 2]])))
    sets += [s[:-1] for s in sets[:40]]  # these link
    n = np.array([len(s) for s in sets])
    d1 = [int(x) for x in sigtree.set_digests(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))[0].view(np.int64)]
    rows = spark.createDataFrame([(k, d1[k], s.tobytes()) for k, s in enumerate(sets)], "rep long, d1 long, items binary").repartition(3)
    classes = spark.createDataFrame([(k, int(n[k]), d1[k], 0, 1) for k in range(len(sets))], "rep long, n long, d1 long, d2 long, members long")
    few, small, many = (x.collect() for x in sigtree._placed(classes, rows, 4, 12))
    whole = small + many
    blocks: dict[int, list] = {}
    for r in whole:
        assert r.level - r.window in (0, 1)
        blocks.setdefault(r.block, []).append(r)
    together = {(a.rep, b.rep) for block in blocks.values() for a in block for b in block if a.level == a.window}
    together |= {(b, a) for a, b in together} | {(a.rep, b.rep) for a in few for b in few if a.block == b.block}
    for a in range(len(sets)):
        for b in range(a):
            assert not sigtree.linked(sets[a], sets[b]) or (a, b) in together
    # One block of all sets would be compared, and sent, in the square of their number.
    assert len(whole) > 100 and sum(len(b) ** 2 for b in blocks.values()) < len(sets) ** 2 / 10
