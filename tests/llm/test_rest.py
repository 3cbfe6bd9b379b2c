"""Top-k, pieces, templates, language model, rollups and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidvec.llm import language, maxent, pieces, pii, rollups, sigtree, templates, topk

SMALL = "/root/testdata/sf0.001"


# --- top-k


def test_top_k_matches_full_scan_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = {k: (rng.integers(-3, 4, 6) / 4).tolist() for k in range(400)}
    vectors |= {k: vectors[7] for k in range(400, 460)}
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (None, [1.0] * 6), (1050, [1.0, 2.0])]
    rows = list(vectors.items()) + odd + [(5, vectors[5]), (9, vectors[9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    whole = topk.integer_vectors(frame)
    queries = whole.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(r) for r in topk.top_k(whole, queries, 5, cell_vectors=70, cell_queries=3).collect())
    ints = {k: [math.floor(256 * x) for x in v] for k, v in vectors.items()}
    want = []
    for q in (k for k in ints if k % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), k) for k, v in ints.items() if k != q)[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(whole.limit(0), queries.limit(0)).count() == 0


def test_threshold_stops_early_where_lists_are_skewed(monkeypatch):
    monkeypatch.setattr(topk, "_DEPTH", 4)
    x = np.zeros((2000, 2))
    x[:, 0], x[:, 1] = np.arange(2000), np.arange(2000)
    read = []
    real = np.unique
    monkeypatch.setattr(topk.np, "unique", lambda a, **k: read.append(len(a)) or real(a, **k))
    found = list(topk.threshold_top_k(x, np.arange(2000), np.array([[1.0, 1.0]]), np.array([-1]), 3))
    assert found[0][1].tolist() == [1999, 1998, 1997] and sum(read) < 200


# --- pieces


def best_segments(model, word, score):
    """Plain dynamic programme over one normal-form word."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for n in range(min(end, model.longest), 0, -1):
            s = score.get(word[end - n : end])
            if s is not None:
                options.append((best[end - n][0] + s, best[end - n][1] + [word[end - n : end]]))
        if word[end - 1] not in score:
            options.append((best[end - 1][0] - 1e12, best[end - 1][1] + [word[end - 1]]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_pieces_match_plain_viterbi_and_round_trip(spark):
    model = pieces.piece_model()
    score = {model.text[i]: s for i, s in zip(model.ids, model.scores, strict=True)}
    number = {t: k for k, t in reversed(list(enumerate(model.text)))}
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(25).collect()]
    texts = [t[:1500] for t in texts] + ["", " ", "\n\n", "  two  blanks ", "漢字 ☃ \U0001f600 é", "a" * 700, "tab\tand\r\nline", " " * 40 + "x", "⁇ "]
    ids, counts = model.encode(texts)
    assert model.decode(ids, counts) == texts
    cut = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        want = []
        for word in re.findall(r"▁+[^▁]*|[^▁]+", ("▁" + t.replace(" ", "▁")) if t else ""):
            for p in best_segments(model, word, score):
                want += [number[p]] if p in score else [int(model.byte_ids[b]) for b in p.encode()]
        assert ids[cut[k] : cut[k + 1]].tolist() == want, t


def test_piece_columns_nulls_and_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the  cat", 3), (2, None, 4), (3, "", 5), (1, "the  cat", 3)], "doc_id long, text string, n_pieces int")
    coded = pieces.encode_pieces(docs)
    back = {(r.doc_id, r.text) for r in pieces.decode_pieces(coded.drop("round_trip")).collect()}
    assert back == {(1, "the  cat"), (2, None), (3, "")}
    assert all(r.round_trip for r in pieces.piece_report(docs).collect()) and pieces.piece_report(docs.limit(0)).count() == 0
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 3)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    model, plain = pieces.PieceModel(pieces.MODEL), pieces.piece_model()
    texts = ["one two three four five six seven " * 5, "two three", "x" * 200]
    assert [a.tolist() for a in model.encode(texts)] == [a.tolist() for a in plain.encode(texts)]


# --- templates


def test_leaks_are_found_also_with_other_figures_names_and_capitals(spark):
    item = "If the baker Anna sells 12 loaves for 3 dollars each and Anna gives 12 loaves to her brother, how many dollars does she earn in 7 days?"
    other = "A train leaves the northern station at noon and reaches the southern harbour when all the lamps are lit along the quay."
    filler = "some quiet words about rivers and mountains stand here before anything else is said today . "
    swapped = item.replace("Anna", "Maria").replace("12", "48").replace("3 dollars", "9 euros")
    mixed = item.replace("sells 12", "sells 48").replace("gives 12", "gives 50")  # one figure of the item meets two values
    rows = [(1, filler + item + filler), (2, filler + swapped), (3, filler * 3), (4, item.upper()), (5, None), (6, ""), (7, filler + mixed), (8, filler + " ".join(other.split()[:7])), (9, other + item), (None, item), (3, filler * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("?"))
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, ""), (None, "x"), (14, "two words")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    found = {(r.doc_id, r.item_id): (r.covered, r.n_windows, r.exact) for r in templates.find_leaks(docs, bench).collect()}
    assert set(found) == {(1, 10), (2, 10), (4, 10), (9, 10), (9, 11)}
    assert found[1, 10][2] and not found[2, 10][2] and found[2, 10][0] == found[2, 10][1]
    report = templates.contamination(docs, bench)
    assert report.count() == len(rows) and {r.doc_id for r in report.filter("contaminated").collect()} == {1, 2, 4, 9}
    kept = templates.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "6", "7", "8", "None"]
    assert templates.find_leaks(docs, bench.limit(0)).count() == 0 and templates.find_leaks(docs.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_blanks_are_found_in_longer_documents(spark):
    items = [(1, "two words"), (2, "白马非马"), (3, "この文章は評価用の問題です。答えを一つ選んでください。"), (4, "12 kg"), (5, "Why is 4 even")]
    docs = [(1, "here are Two words, in a longer text"), (2, "中文：「白马非马」，可乎？"), (3, "前の文。この文章は評価用の問題です。答えを一つ選んでください。後の文"), (4, "it weighs 5 kg"), (5, "it weighs 12 kg in all"), (6, "they asked why is 6 even so small"), (7, "two other words — “two”"), (8, "“two words”—said again"), (9, "白马"), (10, "two")]
    found = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 5), (8, 1)}


def test_long_verbatim_runs_leak_whatever_their_share_and_slots(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    items = [(1, " ".join(words)), (2, "give 12 " + " ".join(words[::2]) + " then 12 more")]
    docs = [(1, "a b c " + " ".join(words[50:70]) + " d e f"), (2, " ".join(words[50:60]) + " and " + " ".join(words[70:80])), (3, "give 48 " + " ".join(words[::2]) + " then 50 more")]
    found = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.covered, r.n_windows) for r in found.collect()} == {(1, 1): (16, 196), (3, 2): (97, 101)}


# --- language model


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\n"]


@pytest.mark.parametrize("frequent", [maxent.FREQUENT, 8])
def test_base_scores_are_exact_and_the_model_adds_up(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 3000 + " A b")], "doc_id long, text string"))
    docs = docs.unionByName(docs.filter("doc_id < 3")).repartition(5)
    rows = docs.collect()
    count = Counter(t for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for t in tokens_of(r.text))
    n, v = sum(count.values()), len(count)
    got = sorted(maxent.score_texts(docs.withColumn("score", F.lit(1))).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for r, g in zip(sorted(rows, key=lambda r: r.doc_id), got, strict=True):
        t = tokens_of(r.text)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(count[x] > 0 for x in t), n)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert abs(g.base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) < 1e-6 * max(1, -g.base_score)
        assert g.score < 0
    assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_probabilities_of_all_next_tokens_sum_to_one():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 60, 3000).astype(np.uint64)
    counts = rng.integers(1, 50, 3000)
    endings = rng.integers(0, 1 << 16, 3000)
    order = np.lexsort((words, -counts))[: maxent.MEMBERS * maxent.FREQUENT_CLASSES]
    group, own = maxent.ending_class(endings), maxent.ending_class(endings[order])
    size = lambda g, w=None: np.bincount(g, weights=w, minlength=maxent.CLASSES)
    totals = maxent.Totals(int(counts.sum()), 3000, words, counts, size(group, counts) - size(own, counts[order]), size(group) - size(own))
    model = maxent.first_model(totals)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    model.inner += rng.normal(0, 0.3, model.inner.shape).astype(np.float32)
    _, slot = totals.lookup(words)
    classes = maxent.classes_of(slot, endings)
    inside = totals.class_counts + maxent.ALPHA * (totals.class_words + 1)
    rows, before = model.features(words[:2], classes[:2], np.array([0, 2]))
    log_class = np.log(maxent._softmax(model.class_scores(rows[1:])))[0]
    p = np.where(slot >= 0, np.exp(log_class[classes] + model.inner_log()[before[1], np.maximum(slot, 0)]), np.exp(log_class[classes]) * (counts + maxent.ALPHA) / inside[classes])
    unseen = (np.exp(log_class) * maxent.ALPHA / inside)[maxent.FREQUENT_CLASSES :].sum()
    assert abs(p.sum() + unseen - 1) < 1e-4


def test_every_training_row_moves_the_weights(spark):
    rows = [(k, f"only{k} follows" if k % 100 == 1 else "a b") for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = maxent.train(docs, maxent.totals_of(maxent.training_counts(docs)))
    taught = [t for k, t in rows if t != "a b" and zlib.crc32(str(k).encode()) % 10]
    for text in taught:
        data = np.frombuffer(text.encode(), np.uint8)
        tokens, ending, at = maxent.token_stream(data, np.array([0, len(data)]))
        seen, _ = model.features(tokens, maxent.ending_class(ending), at)
        assert model.weights[seen[1, 0]].any() and model.weights[seen[1, 2]].any(), text


def test_feature_table_grows_with_the_training_tokens(spark):
    sizes = [maxent.buckets_of(n) for n in (0, 10**6, 10**9, 10**12)]
    assert sizes == sorted(set(sizes)) and sizes[0] == maxent.BUCKETS
    for n in (1, 400):
        docs = spark.createDataFrame([(k, "a b c d e f g h i") for k in range(n)], "doc_id long, text string")
        totals = maxent.totals_of(maxent.training_counts(docs))
        model = maxent.train(docs, totals)
        assert model.buckets == maxent.buckets_of(totals.n) == len(model.weights) - 1


def test_sums_by_row_are_those_of_single_additions():
    rng = np.random.default_rng(3)
    g = rng.normal(size=(50, maxent.CLASSES))
    flat = np.concatenate([rng.integers(0, 6, 100), rng.integers(0, 5000, 150)])
    name, got = maxent._sums_by_row(flat, g)
    want = {int(r): np.zeros(maxent.CLASSES) for r in flat}
    for k, r in enumerate(flat):
        want[int(r)] += g[k % 50]
    assert name.tolist() == sorted(want) and np.allclose(got, [want[r] for r in name.tolist()])


def test_empty_language_model(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.score_texts(empty).count() == 0


# --- rollups


def test_rollups_match_recounting_and_commits_repeat_safely(spark, tmp_path):
    rows = [(1, "s", "en", "a b c"), (2, "s", "en", "d"), (3, None, "de", None), (4, "t", None, "x y"), (4, "t", None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("version", F.lit("?"))
    ledger = rollups.token_ledger(docs, {"w": None, "b": rollups.VOCABULARY})
    words, pairs = rollups.counts_of(ledger, "w"), rollups.counts_of(ledger, "b")
    store = rollups.Rollups(spark, str(tmp_path / "totals"))
    store.commit(1, rollups.signed(words, 1))
    before = sorted(map(str, store.totals().collect()))
    gone = words.filter("doc_id = 1")
    for _ in range(3):
        store.commit(2, rollups.signed(gone, -1))
    store.commit(3, rollups.revised(words.filter("doc_id = 4"), pairs.filter("doc_id = 4")))
    store.commit(4, rollups.signed(words.limit(0), 1))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_bytes) for r in store.totals().collect()}
    assert got == {("s", "en", "w"): (1, 1, 1), (None, "de", "w"): (1, 0, 0), ("t", None, "b"): (2, 2 * pairs.filter("doc_id = 4").first().n_tokens, 6)}
    small = store.compact(9, str(tmp_path / "compact"))
    assert sorted(map(str, small.totals().collect())) == sorted(map(str, store.totals().collect())) != before
    store.commit(2, rollups.signed(gone.limit(0), -1))
    store.commit(3, rollups.signed(words.limit(0), 1))
    assert sorted(map(str, store.totals().collect())) == before


def test_long_texts_are_tokenized_in_pieces_with_equal_counts():
    encoding = rollups._encoding(rollups.VOCABULARY)
    text = " ".join(f"word{k} some, text {k} é!  more" for k in range(800)) + " " * 50 + "end" + "z" * 300
    whole = len(encoding.encode_ordinary(text))
    for size in (10, 97, 1000):
        parts = list(rollups.pieces(text, size))
        assert "".join(parts) == text and sum(len(encoding.encode_ordinary(p)) for p in parts) == whole


# --- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = docs.orderBy("doc_id").collect()
    rows = [r for r in rows if language.has_letter(r.text)]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows if (w := tokens_of(r.text)[:-1])}
    first = {r.doc_id: r.doc_id for r in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(first[a], first[b]), min(first[a], first[b])
                first = {k: new if v == old else v for k, v in first.items()}
    rows = [r for r in rows if first[r.doc_id] == r.doc_id]
    items = [re.findall(r"[^\W_]+", b.text.lower()) for b in bench.collect()]
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    clean = [r for r in rows if not any(f" {' '.join(i)} " in flat(r.text) for i in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) <= {r.doc_id for r in clean} and len(got) >= len(clean) - 2
    finder, model = pii.Finder(), pieces.piece_model()
    for r in clean:
        if r.doc_id in got:
            ids, n = model.encode([pii.redact(r.text, finder.spans(r.text))])
            assert got[r.doc_id].ids == ids.tolist() and got[r.doc_id].n_pieces == n[0] and got[r.doc_id].round_trip


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, "the of and to in that is", "en", "s", 3, 9), (2, None, None, None, None, 8), (None, "a@b.co the of and to in", "en", "s", 1, 7), (1, "the of and to in that is", "en", "s", 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SMALL)
            assert out.count() <= given.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == given.columns
    assert len(corpus_pipeline.STAGES) == 5 and sigtree.PERCENT == 75
