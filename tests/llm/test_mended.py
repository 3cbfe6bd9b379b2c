"""Faults found in review: windows of figures, long links and account numbers, batches that were folded."""

import random
import time

import numpy as np

from braidvec.llm import pii, rollups, templates


def plain_leaks(docs, items):
    """Every window of every document against every window of every item."""

    def windows(text, form, size, whole):
        data = np.frombuffer(text.encode(), np.uint8)
        words, plain, typed, at = templates.tokens(data, np.array([0, len(data)]))
        stream = (plain, typed)[form]
        marks = {int(x) for x in (templates._NUMBER, templates._NAME, templates._UNIT)}
        n = len(words)
        size = min(size, n) if whole else size
        out = []
        for k in range(n - size + 1 if size else 0):
            w, s = words[k : k + size].tolist(), stream[k : k + size].tolist()
            literal = sum(x not in marks for x in s)
            out.append((("words", *w) if literal < templates.LITERAL else ("form", *s), w))
        return out

    found = {}
    for item, question in items:
        for doc, text in docs:
            best = 0, False
            total = len(windows(question, 0, templates.WINDOW, True))
            for form in (0, 1):
                mine = windows(question, form, templates.WINDOW, True)
                if not mine:
                    continue
                theirs = windows(text, form, len(mine[0][1]), False)
                lines = {}
                for i, (a, was) in enumerate(mine):
                    for k, (b, now) in enumerate(theirs):
                        if a[1:] == b[1:] and (a[0] == b[0] == "form" or was == now):
                            lines.setdefault(k - i, []).append((i, was, now))
                covered, long = set(), False
                for line in lines.values():
                    slots = {p for _, was, now in line if was != now for p in zip(was, now, strict=True)}
                    verbatim = sorted(i for i, was, now in line if was == now)
                    run = most = 0
                    for k, i in enumerate(verbatim):
                        run = run + 1 if k and i == verbatim[k - 1] + 1 else 1
                        most = max(most, run)
                    lasting = bool(most) and most + templates.WINDOW - 1 >= templates.RUN
                    if len(slots) == len({was for was, _ in slots}):
                        covered |= {i for i, _, _ in line}
                    elif lasting:
                        covered |= set(verbatim)
                    long |= lasting
                best = max(best[0], len(covered)), best[1] or long
            if best[0] >= total * templates.COVERAGE and best[0] or best[1]:
                found[doc, item] = best[0], total
    return found


def test_leaks_match_the_quadratic_search(spark):
    rng = random.Random(5)
    words = ["sell", "loaf", "for", "each", "many", "Anna", "Maria", "Tom", "river", "12", "48", "7", "3.5", "kg", "days", "day", "how", "."]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 4, 6, 12, 25, 40]))) for k in range(25)]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            parts += [" ".join(copy), text(rng.randrange(10))]
        docs.append((k, " ".join(parts)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.n_windows) for r in templates.find_leaks(*frames).collect()}
    assert got == plain_leaks(docs, items) and len(got) > 20


def test_rows_of_figures_do_not_match_each_other(spark):
    """A table of numbers and items of numbers share no window, a copied sequence is found."""
    items = [(k, " ".join(str(1000 * k + 7 * j) for j in range(40))) for k in range(10)]
    docs = [(1, " ".join(str(10**6 + k) for k in range(20_000))), (2, "see " + items[3][1] + " there"), (3, " | ".join(f"Row{k} {k} kg" for k in range(5000)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    known = templates.benchmark_windows(items)
    bits = templates.bitmap(known, known["hash"])
    windows = docs.selectExpr("doc_id as id", "text").mapInArrow(templates._windows(templates.WINDOW, bits), templates._WINDOW_SQL)
    assert windows.join(known, ["hash", "form"]).count() < 1000
    assert [(r.doc_id, r.item_id) for r in templates.find_leaks(docs, items).collect()] == [(2, 3)]


def test_links_and_accounts_of_any_length():
    finder = pii.Finder()
    for n in (10, 5000):
        text = "see https://example.org/" + "a" * n + "). Then"
        assert ("url", 4, 24 + n) in finder.spans(text)
    for n in (30, 40, 3000):
        text = "account: " + "12345" * (n // 5) + " end"
        assert ("account", 9, 9 + n) in finder.spans(text)
    assert not [s for s in finder.spans("account: abcdefgh") if s[0] == "account"]


def test_links_and_cues_take_linear_time():
    finder = pii.Finder()
    begin = time.process_time()
    for text in ("http://a.example/x, " * 100_000, "-account" * 100_000, "-account7" * 50_000, "www." * 200_000, "https://" + "." * 500_000):
        finder.spans(text)
    assert time.process_time() - begin < 20


def test_folded_batches_are_not_counted_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "en", "w", 3, 9), (2, "s", "de", "w", 4, 8)], "doc_id long, source string, lang string, version string, n_tokens long, n_bytes long")
    store = rollups.Rollups(spark, str(tmp_path / "a"))
    assert store.totals().count() == 0
    store.commit(1, rollups.signed(rows, 1))
    store.commit(2, rollups.signed(rows.filter("doc_id = 2"), -1))
    small = store.compact(3, str(tmp_path / "b"))
    want = sorted(map(str, store.totals().collect()))
    for batch in (1, 2):
        small.commit(batch, rollups.signed(rows, 1))
    assert sorted(map(str, small.totals().collect())) == want
    small.commit(4, rollups.signed(rows, 1))
    smaller = small.compact(5, str(tmp_path / "c"))
    for batch in (1, 2, 3, 4):
        smaller.commit(batch, rollups.signed(rows, 1))
    assert sorted(map(str, smaller.totals().collect())) == sorted(map(str, small.totals().collect())) != want
