import random

import numpy as np
from pyspark.sql import functions as F

from cairnfield.llm import language, quality, toxicity

LANGS = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "zwölf boxkämpfer jagen viktor quer über".split(), "cc": "el veloz murciélago hindú comía feliz".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


def lang_rows():
    rng = random.Random(1)
    return [(i, text(rng, "abc"[i % 3] * 2), "abc"[i % 3] * 2) for i in range(150)]


def test_language_held_out_and_odd_texts(spark):
    df = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    model = language.learn(df.filter("doc_id < 100"))
    odd = [(1000, None, None), (1001, "", None), (1002, "12 %% 3", None), (1003, "²", None), (1004, "ö", None), (None, "lorem " * 5000, None)]
    out = language.identify(df.filter("doc_id >= 100").union(spark.createDataFrame(odd, df.schema)), model).collect()
    truth = {i: lang for i, _, lang in lang_rows()}
    assert all(truth[r.doc_id] == r.lang_pred and 0 <= r.score <= 1 for r in out if r.doc_id is not None and r.doc_id < 1000)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and by[1000].ambiguous
    assert by[1004].lang_pred != "und" and by[None].lang_pred == "aa"


def test_language_with_one_or_no_learned_value(spark):
    df = spark.createDataFrame(lang_rows()[:9], "doc_id long, text string, lang string")
    one = language.identify(df, language.learn(df.filter("lang = 'aa'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("aa", 1.0)}
    none = language.identify(df, language.learn(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 6, 12, 40):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)


def toxic_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = text(rng, "aa", 80).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefoot", "snarkwit"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(toxicity.sample(docs, lab.filter("doc_id < 300"), "doc_id", "toxic"))
    held = docs.filter("doc_id >= 300").union(spark.createDataFrame([(None, None), (1000, ""), (1001, "lorem " * 20000 + "snarkwit")], docs.schema))
    got = {r.doc_id: r.score for r in toxicity.score_texts(held, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    assert got[None] == got[1000] < 0.5 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_both_labels(spark):
    rows, labels = toxic_rows()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for some in (lab.limit(0), lab.filter("toxic = 0")):
        model = toxicity.learn(toxicity.sample(docs, some, "doc_id", "toxic"))
        assert toxicity.score_texts(docs, model).filter("score >= 0.7").count() == 0


def test_toxicity_score_column_is_replaced_and_empty_works(spark):
    docs = spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, score string")
    model = toxicity.Model(np.zeros(toxicity.SIZE, np.float32), 0.0)
    assert [r.score for r in toxicity.score_texts(docs, model).collect()] == [0.5]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def quality_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = text(rng, "aa").split()
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words) + ".", f"h{i % 7}" if i % 3 else "hot", "en"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


SCHEMA = "doc_id long, text string, source string, lang string"


def judge(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    return quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), *quality.document_sites())


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rows, labels = quality_rows()
    got = {r.doc_id: r for r in judge(spark, rows, labels[:200]).collect()}
    assert len(got) == 300 and all(got[i].keep == (i % 5 != 0) for i in got)
    assert all(0 < r.host_rate < 1 and 0 < r.path_rate < 1 for r in got.values())


def test_quality_shrinks_sparse_sites_to_the_global_rate(spark):
    many = [("good", "p", 0.95)] * 200 + [("bad", "p", 0.1)] * 200 + [("tiny", "p", 0.0)]
    got = {r.host: r for r in quality.site_posteriors(spark.createDataFrame(many, "host string, path string, good double")).collect()}
    rate = got["tiny"].global_rate
    assert abs(got["good"].host_rate - 0.95) < 0.05 and abs(got["bad"].host_rate - 0.1) < 0.05
    assert 0.1 < got["tiny"].host_rate < rate


def test_quality_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None), (1, "", "h", None), (1, "", "h", None), (2, "a b c", None, "en")]
    out = judge(spark, rows, [(1, 1), (1, 0), (2, None)]).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert judge(spark, [], []).count() == 0


def test_features_of_odd_texts():
    data = b"aa aa aa aa|b%\n\n" + "é".encode()
    off = np.array([0, 0, 16, len(data)])
    x = quality.features(np.frombuffer(data, np.uint8), off)
    assert np.isfinite(x).all() and x[0][-1] == 1 and x[1][quality.FEATURES.index("longest_repeat")] > 0.5


def test_queries_run(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for q in (language.query, toxicity.query, quality.query):
        assert q(spark, sf_dir).agg(F.count(F.lit(1))).first()[0] == n


def test_toxicity_with_clashing_columns(spark):
    from cairnfield.llm import toxicity

    docs = spark.createDataFrame([(i, "nasty words here" if i % 2 else "kind words there", 5, 6) for i in range(40)], "doc_id long, text string, label int, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    chosen = toxicity.sample(docs, labels, "doc_id", "toxic")
    assert {r.label for r in chosen.collect()} == {0, 1}
    out = toxicity.score_texts(docs, toxicity.learn(chosen)).collect()
    assert len(out) == 40 and all(0 <= r.score <= 1 and r.label == 5 for r in out)
