"""Personal data against the plain rules, language and quality by held-out accuracy, and the edge cases of all three."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidvec.llm import language, pii, quality

SMALL = "/root/testdata/sf0.01"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, rule in RULES:
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = True
            if kind == "ip":
                good = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
                good = 14 <= len(digits) <= 19 and total % 10 == 0
            elif kind == "phone":
                good = 10 <= len(digits) <= 15
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], [k for k, _ in RULES].index(s[0])))


def samples():
    rng = np.random.default_rng(1)
    bits = ["a@b.co", "x.y+z@mail.example.org", "@", "a@b", "@c.d", "1.2.3.4", "300.1.1.1", "001.02.3.4", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49", "++4 30 1234567 8", " ", "\n", "é", "-", ".", "7", "42", "token = \"abcdefghijklmnopqrst12\"", "https://a.b/c?d", "www.x.org", "IBAN DE89370400440532013000", "a@b.c@d.e", "İ"]
    return ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(1500)]


def test_base_spans_follow_the_rules():
    finder = pii.Finder()
    for text in samples():
        got = [s for s in finder.spans(text) if s[0] in pii.BASE_KINDS]
        assert got == plain(text), text


def test_added_kinds_and_redaction():
    finder = pii.Finder()
    text = "see https://a.example/x, account no. 12345678 and api_key = 'abcdefghijklmnopqrstuvwx' or a.b@c.de"
    kinds = [text[a:b] for _, a, b in finder.spans(text)]
    assert kinds == ["https://a.example/x", "12345678", "abcdefghijklmnopqrstuvwx", "a.b@c.de"]
    assert pii.redact(text, finder.spans(text)) == "see [URL], account no. [ACCOUNT] and api_key = '[SECRET]' or [EMAIL]"


def test_long_secrets_printed_ibans_and_letters_that_grow_in_lower_case():
    finder = pii.Finder()
    clean = lambda t: pii.redact(t, [s for s in finder.spans(t) if s[0] in pii.EXTRA_KINDS])
    for n in (20, 128, 129, 5000):
        assert clean(f"token={'aB3_' * n} end"[: n + 6] + " end") == "token=[SECRET] end"
    for number in ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "de89370400440532013000", "NO93 8601 1117 947", "MT84\xa0MALT 0110 0001 2345 MTLC AST0 01S"):
        assert clean(f"IBAN: {number} please pay") == "IBAN: [ACCOUNT] please pay"
    assert clean("IBAN: DE88 3704 0044 0532 0130 00") == "IBAN: DE88 3704 0044 0532 0130 00"  # wrong check digits
    assert clean("\u0130stanbul, IBAN DE89370400440532013000, Password: abcdefghij0123456789 and ACCOUNT 12345678") == "\u0130stanbul, IBAN [ACCOUNT], Password: [SECRET] and ACCOUNT [ACCOUNT]"


def test_long_runs_take_linear_time():
    finder = pii.Finder()
    begin = time.process_time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "0" * 200_000 + ".0.0.0"):
        finder.spans(text)
    assert time.process_time() - begin < 20


def test_report_and_edge_cases(spark):
    rows = [(1, "a@b.co and +1 (555) 010-9999", "x"), (2, None, "y"), (3, "", None), (None, "1.2.3.4", "z"), (1, "a@b.co and +1 (555) 010-9999", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.pii_report(docs).collect()), key=str)
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or "")).encode()).hexdigest()
    one = (1, 1, 0, 0, 1, digest(rows[0][1]), "email:0:6,phone:11:28")
    assert got == sorted([one, one, (2, 0, 0, 0, 0, digest(""), ""), (3, 0, 0, 0, 0, digest(""), ""), (None, 0, 1, 0, 0, digest("1.2.3.4"), "ip:0:7")], key=str)
    clean = pii.redact_pii(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.collect()} == {"[EMAIL] and [PHONE]", None, "", "[IP]"}
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_language_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.identify(docs.withColumn("lang_pred", F.lit("q"))).join(docs.select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
    model = language.learn_languages(docs)
    assert model.langs == sorted(model.langs)
    lang, score = model.predict([None, "", "1234 -- !", "the of and to in", "x" * 400_000])
    assert lang[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and lang[3] == "en" and 0 <= score[4] <= 1
    nothing = language.learn_languages(docs.limit(0))
    assert nothing.langs == [] and nothing.predict(["abc"])[0] == ["und"]
    odd = spark.createDataFrame([(1, "12 !", None, 1), (2, None, "en", 2), (3, "the and of it that was", None, 3)], "doc_id long, text string, lang string, score int")
    assert [r.doc_id for r in language.keep_identified(odd, model).collect()] == [3]
    assert [r.doc_id for r in language.keep_identified(odd, nothing).collect()] == [3]


def test_long_texts_are_counted_once_in_pieces():
    text = "".join(chr(97 + k % 23) for k in range(1000))
    for limit in (7, 64, 5000):
        seen = [b for piece in language._pieces([text, "zz"], limit) for owner, b in language._features(*piece, 15)]
        assert sum(map(len, seen)) == sum(len(" " + t) - k + 1 for t in (text, "zz") for k in language.ORDERS)


def test_quality_held_out_accuracy_and_edge_cases(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.85
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 6.0), (None, "abc", 7.0), (2, "", 6.0)], "doc_id long, text string, score double")
    for given in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = quality.classify(odd, given).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(4)
    net = quality.ByteNet(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)), rng.normal(size=2 * quality.FILTERS), 0.1, np.ones(2 * quality.FILTERS), np.zeros(2 * quality.FILTERS))
    texts = [rng.integers(0, 256, int(n)).astype(np.uint8) for n in (0, 1, 7, 63, 64, 65, 255, 256, 257, 449, 1000)]
    whole = net.score(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    single = [net.score(t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(whole, single, atol=1e-5)
    # The last chunk's windows alone, by definition of the filters.
    t = np.concatenate([texts[3], np.zeros(8, np.uint8)])
    want = np.max([sum(net.filters[k, t[i + k]] for k in range(quality.WIDTH)) for i in range(63)], 0)
    layout = quality.Layout(texts[3], np.array([0, 63]))
    features, _ = quality.pool(layout, net.responses(layout))
    assert np.allclose(features[0, : quality.FILTERS], want, atol=1e-4)


@pytest.mark.parametrize("size", [0, 10, 8192, 8193, 100_000])
def test_training_pieces_spread_over_the_text(size):
    text = bytes(k % 251 for k in range(size))
    assert len(quality.spread(text)) == min(size, quality.SAMPLE_BYTES)
