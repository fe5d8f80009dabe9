import base64
import random
import string

import numpy as np
from pyspark.sql import functions as F

from gneiss.llm import langid, registry, toxicity
from gneiss.llm.samples import SparseRows, word_features

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = registry.op7_langid(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    row = got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and row[1] < 0.01 and row[2] >= 0 and row[3] <= 1
    assert got.count() == truth.count()


def test_language_edges(spark):
    rows = [(1, "der und die Katze", "de"), (4, "the cat and the dog", "en"), (5, None, "en"), (6, "123 .,", "en"), (7, "", None), (8, "the dog", None), (None, "the dog", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id is not null"))
    got = langid.identify_language(docs.select("doc_id", "text", F.lit("x").alias("lang")), model).collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 4, 5, 6, 7, 8, None)] == ["de", "en", "und", "und", "und", "en", "en"]
    assert by[5].score == 0 and by[5].rejected and by[1].lang == "x"
    empty = langid.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in langid.identify_language(docs.select("doc_id", "text"), empty).collect()} == {"und"}


def test_language_rejects_what_was_not_learned(spark):
    rnd = random.Random(4)
    junk = [" ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(3, 9))) for _ in range(n)) for n in (30, 60, 200, 800)]
    junk += [base64.b64encode(rnd.randbytes(n)).decode() for n in (150, 800, 5000)] + [rnd.randbytes(n).hex() for n in (100, 500)]
    junk += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神互相对待。",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = langid.is_held_out("doc_id")
    model = langid.fit_languages(docs.where(~held_out))
    assert all(model.predict(junk)[2])
    texts = [r.text for r in docs.where(held_out).where("length(text) > 300").select("text").collect()]
    for size in (20, 60, 150):
        assert np.mean(model.predict([t[:size] for t in texts])[2]) < 0.03


def test_ordinal_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=900) * 0.2, [0.5, 2.5])
    dense, (row, column) = x, np.indices(x.shape).reshape(2, -1)
    x = SparseRows(row, column, dense.reshape(-1), *dense.shape)
    assert np.allclose(x.times(np.arange(3.0)), dense @ np.arange(3.0)) and np.allclose(x.transposed_times(grade), dense.T @ grade)
    w, cuts = toxicity.fit_ordinal(x, grade, 2, 1e-6)
    assert cuts[0] < cuts[1] and w[0] > 0 > w[1] and abs(w[2]) < 0.5 * abs(w[1])
    model = toxicity.OrdinalModel({}, w, cuts)
    below = model.at_most(x)
    assert (below[:, 0] <= below[:, 1]).all()
    assert np.corrcoef((1 - below).sum(axis=1), grade)[0, 1] > 0.9


def test_toxicity_finds_planted_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 <> 0"))
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("doc_id % 3 = 0")
    rows = got.select("y", "toxic", "severity", "grade").collect()
    assert sum(r.toxic for r in rows if r.y) >= 0.6 * sum(r.y for r in rows)
    assert sum(r.toxic for r in rows if not r.y) <= 0.03 * len(rows)
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in rows)


def test_toxicity_edges(spark):
    rows = [(1, "vile vile words", 1), (2, "vile thing here", 1), (3, "vile stuff again", 1), (4, "fine day", 0), (5, None, 0), (6, "", 1), (7, "good day", 0), (7, "good day", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    few = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), few).collect()
    assert len(got) == 8 and all(r.severity >= 0 for r in got)
    none = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").limit(0))
    assert {r.severity for r in toxicity.score_toxicity(docs.select("doc_id", "text"), none).collect()} == {0.0}
    assert word_features(None) == []


def test_language_scores_match_a_plain_loop(spark):
    """Cosines of every centroid by dictionaries of n-grams, with the fitted model given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    model = langid.fit_languages(docs)
    dims = len(model.idf)
    got = {r.doc_id: r for r in langid.identify_language(docs.select("doc_id", "text"), model).collect()}
    for r in docs.select("doc_id", "text").limit(25).collect():
        counts = langid.gram_counts(r.text, dims)
        held = {int(g): float(np.sqrt(counts[g])) * float(model.idf[g]) for g in np.flatnonzero(counts)}
        norm = sum(v * v for v in held.values()) ** 0.5
        cosines = [sum(v * float(c[g]) for g, v in held.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]]
        assert abs(got[r.doc_id].score - min(1.0, max(0.0, cosines[best]))) < 1e-4


def test_ngrams_match_a_plain_count():
    """Equal n-grams fall in equal slots: counts by slot are sums over plain counts of n-grams."""
    text, dims = "Die Katze, die Maus 12 und é", 1 << 20
    raw = b" die katze die maus und \xc3\xa9 "
    plain = {}
    for n in (2, 3, 4):
        for k in range(len(raw) - n + 1):
            plain[raw[k : k + n]] = plain.get(raw[k : k + n], 0) + 1
    counts = langid.gram_counts(text, dims)
    assert sorted(counts[counts > 0].tolist()) == sorted(plain.values())


def test_severities_match_a_plain_loop(spark):
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.where("doc_id % 10 = 0")
    got = {r.doc_id: r for r in toxicity.score_toxicity(some, model).collect()}
    for r in some.collect():
        count = Counter(w for w in word_features(r.text) if w in model.place)
        z = sum(math.log1p(n) * model.weights[model.place[w]] for w, n in count.items())
        over = [1 - 1 / (1 + math.exp(min(40, max(-40, z - t)))) for t in model.thresholds]
        assert abs(got[r.doc_id].severity - sum(over)) < 1e-6 and got[r.doc_id].toxic == (over[0] >= 0.5)


def test_samples_are_the_same_for_any_order(spark):
    from gneiss.llm.samples import labelled_sample

    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (3, "another"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (9, 1), (None, 0)], "doc_id long, y int")
    for parts in (1, 3):
        got = labelled_sample(docs.repartition(parts), labels.repartition(parts), 10).collect()
        assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "same", 0), (3, "another", 1)]


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text number {i} of the language", "en") for i in range(300)] + [(1000 + i, f"eine zeile {i}", "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, per_language=20, clusters=50)
    assert model.languages == ["de", "en"] and list(np.bincount(model.owner)) == [5, 20]
