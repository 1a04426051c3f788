"""Language, toxicity and quality: held-out accuracy, exact bounds, odd input."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cohortlens.llm import language_id, quality_rules, toxicity
from cohortlens.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = documents(spark, SF)
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 %% 34", "en", "s", 0), (-3, "", None, "s", 0)], docs.schema)
    docs = docs.union(odd).withColumn("rejected", F.lit(1)).withColumn("lang_pred", F.lit(2))
    got = language_id.identify(docs, ["doc_id", "lang"]).withColumn("held", language_id.held_out(F.col("doc_id"))).toPandas()
    real = got[(got.doc_id >= 0) & got.held]
    assert (real.lang == real.lang_pred).mean() > 0.98 and real.rejected.mean() < 0.02
    bad = got[got.doc_id < 0]
    assert (bad.lang_pred == "und").all() and (bad.score == 0).all() and bad.rejected.all()
    assert got.score.between(0, 1).all()


def test_language_rejects_other_alphabets_and_needs_no_model(spark):
    docs = documents(spark, SF)
    model = language_id.train(docs, 100)
    strange = spark.createDataFrame([(1, "Ωμέγα и текст на другом языке " * 20)], "doc_id bigint, text string")
    assert language_id.label(strange, model).first().rejected
    assert language_id.train(docs.limit(0)) is None
    assert language_id.label(strange, None).first().lang_pred == "und"


def test_small_languages_reject_beside_a_large_one(spark):
    import random

    rng = random.Random(6)

    def text(letters, n=60):
        return " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))

    rows = [(i, text("abcdefgh"), "large") for i in range(400)] + [(1000 + i, text("opqrstuv"), "small") for i in range(60)]
    docs = spark.createDataFrame([*rows, (2000, text("klmn"), "one")], "doc_id bigint, text string, lang string")
    model = language_id.train(docs, 100)
    assert model.languages == ["large", "one", "small"]
    assert all(map(math.isfinite, model.mean)) and (model.spread > 0).all()
    junk = [(i, text("opqrstwx")) for i in range(2)]  # closest to the small language
    own = [(10 + i, text("opqrstuv")) for i in range(20)] + [(50 + i, text("abcdefgh")) for i in range(20)]
    got = language_id.label(spark.createDataFrame(junk + own, "doc_id bigint, text string"), model).collect()
    assert all(r.lang_pred == "small" and r.rejected for r in got if r.doc_id < 10)
    assert not any(r.rejected for r in got if r.doc_id >= 10)
    assert {r.lang_pred for r in got if r.doc_id >= 50} == {"large"}


def test_one_scoring_equals_training_and_labelling_apart(spark):
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "no id here", "en"), (-5, "kein Wort", None)], docs.schema))
    named = docs.withColumn("own_bits", F.lit("kept")).withColumn("held_back", F.lit(1)).withColumn("a.b", F.col("doc_id"))
    got = language_id.identify(named)
    assert got.columns == [*named.columns, "lang_pred", "score", "cross_entropy", "rejected"]
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    want = language_id.label(docs, model, ["doc_id"])
    both = [sorted(map(str, x.select("doc_id", "lang_pred", "score", "cross_entropy", "rejected").collect())) for x in (got, want)]
    assert both[0] == both[1]
    assert language_id.identify(docs.limit(0)).count() == 0


def test_a_worker_keeps_one_thing():
    import gc
    import weakref

    from cohortlens.llm import common

    class Thing:
        pass

    first = weakref.ref(common.held("a", Thing))
    assert common.held("a", Thing) is first()
    second = common.held(("b", 1), Thing)
    gc.collect()
    assert first() is None and common.held(("b", 1), Thing) is second and len(common._HELD) == 1


def test_kneser_ney_sums_to_one():
    units = ["abab", "abc", "ca", "b"]
    import numpy as np

    grams, contexts, base = language_id.estimate(units, np.array([3.0, 1, 2, 1]))
    keys, chance = grams[0]
    back = contexts[0][1][0]
    assert math.isclose(chance.sum() + back * base, 1.0, rel_tol=1e-12)  # one unseen symbol


def test_toxic_documents(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.fit(toxicity.graded(docs, labels.filter(half)))
    rest = labels.filter(~half).withColumnRenamed("toxic", "label")
    got = toxicity.predict(docs, model).join(rest, "doc_id").select("label", "toxic", "expected_severity").toPandas()
    assert got[got.label == 1].toxic.mean() > 0.85 and got[got.label == 0].toxic.mean() < 0.01
    assert got.expected_severity.between(0, 3).all()
    assert list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_of_odd_input(spark):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x" * 100_000)], "doc_id bigint, text string")
    got = toxicity.grade(docs.withColumn("grade", F.lit(9)), labels).collect()
    assert len(got) == 4 and not any(r.toxic or r.expected_severity for r in got)
    assert toxicity.grade(docs.limit(0), labels).count() == 0


def plain(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_quality_measures_equal_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    odd = [(-1, None, None), (-2, "", "en"), (-3, " \t\x0b a b c a b c\n\n a b c\na b c\n \n", "xx"), (-4, "a a a a a", "en"), (-4, "a a a a a", "en")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit(1)).withColumn("grid", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs, labels).collect():
        n = plain(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 50, 500, 5000, 40_000) for k in (0, 1, 3, 10, 80, 700) if k < n * 0.02]
    rows = spark.createDataFrame(cases, "k bigint, n bigint").withColumn(
        "t", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for r in rows:
        log = (lambda j: math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.02) + (r.n - j) * math.log(0.98))
        assert math.isclose(r.t, sum(math.exp(log(j)) for j in range(r.k + 1)), rel_tol=1e-7, abs_tol=1e-300)


def test_cutoffs_limit_false_rejection(spark):
    rows = [(i, "xx", [i % 100, 0, 0, 0, 0], False) for i in range(20_000)]
    measured = spark.createDataFrame(rows, "doc_id bigint, stratum string, grid array<int>, base_failed boolean")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    cut = quality_rules.cutoffs(measured, labels).first().cuts[0]
    assert cut == 98  # beyond it lie 1 %, beyond the next lower value the whole 2 %
    few = quality_rules.cutoffs(measured, labels.filter("doc_id < 100")).collect()
    assert not few or few[0].cuts[0] is None


def test_a_model_comes_to_the_driver_in_few_packed_rows(spark, monkeypatch):
    import numpy as np

    docs = spark.createDataFrame([("a", "some words and more of some other words " * 3), ("b", "weitere Worte"), ("c", "1 2")],
                                 "lang string, text string")
    came, kind = [], type(docs)
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (came.append(out := f(self)), out)[1])
    model = language_id.learn(docs)
    assert len(came) == 1 and len(came[0]) == 2 * (2 * language_id.ORDER + 1)  # not a row an n-gram
    assert model.languages == ["a", "b"]
    units = [(["some", "words", "and", "more", "of", "other"], [6.0, 6, 3, 3, 3, 3]), (["weitere", "worte"], [1.0, 1])]
    want = [language_id.estimate(x, np.array(n)) for x, n in units]
    for found, place, missing in ((model.grams, 0, 0.0), (model.contexts, 1, 1.0)):
        for k, (keys, values) in enumerate(found):
            whole = language_id._joined([w[place][k] for w in want], missing)
            assert (keys == whole[0]).all() and (values == whole[1]).all()
    assert model.floor.tolist() == [w[2] for w in want]
    monkeypatch.setattr(language_id, "PIECE", 3)  # tables in several pieces, in any order
    came.clear()
    again = language_id.learn(docs)
    assert len(came[0]) > 60
    again = language_id._assembled(came[0].take(np.random.default_rng(1).permutation(len(came[0]))))
    for x, y in zip(model.grams + model.contexts, again.grams + again.contexts):
        assert (x[0] == y[0]).all() and (x[1] == y[1]).all()
    assert language_id.learn(docs.filter("lang = 'c'")) is None
