import numpy as np
import pytest

from gneiss.operators import ml, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:200] += [12, 0, 0]
    y = 3 + x @ [2.0, -1.0, 0.5] + rng.normal(size=400) * 0.1
    rows = [(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))] + [(400, None, 1.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(4)


XS = ["a", "b", "c"]


def fitted(table):
    return {"linear": models.fit_linear(table, "y", XS), "kmeans": models.fit_kmeans(table, XS, 2), "forest": models.fit_forest(table, XS, trees=10, sample=64)}


def test_saved_models_score_alike(spark, table, tmp_path):
    rows = {r.id: [r.a, r.b, r.c] for r in table.collect()}
    for kind, model in fitted(table).items():
        assert models.save(spark, model, str(tmp_path), kind) == 1
        again = models.load(spark, str(tmp_path), kind)
        assert again == model and again.version == 1 and again.rows == 400
        got = {r.id: r.prediction for r in models.score(table, again).collect()}
        assert got == {r.id: r.prediction for r in models.score(table, model).collect()}
        assert got.pop(400) is None
        want = models.predictor(model)(np.array([rows[k] for k in got]))
        assert list(got.values()) == pytest.approx(want.tolist())


def test_each_kind_is_right(spark, table):
    made = fitted(table)
    assert made["linear"].arrays["coefficients"] == pytest.approx([2.0, -1.0, 0.5], abs=0.05)
    clusters = {r.id: r.prediction for r in models.score(table, made["kmeans"]).collect()}
    assert len({clusters[k] for k in range(200)}) == len({clusters[k] for k in range(200, 400)}) == 1 and clusters[0] != clusters[399]
    nested = ml.plant(np.random.default_rng(1).normal(size=(50, 3)), 5, 32)

    def depth(x, node, d=0):
        return d + node if not isinstance(node, tuple) else depth(x, node[2] if x[node[0]] < node[1] else node[3], d + 1)

    x = np.random.default_rng(2).normal(size=(20, 3))
    got = models.forest_scores(models.flat_trees(nested) | {"size": [32.0]})(x)
    assert got == pytest.approx([2 ** (-np.mean([depth(r, t) for t in nested]) / ml.average_path(32)) for r in x])


def test_versions_and_digest(spark, table, tmp_path):
    folder = str(tmp_path)
    assert models.versions(spark, folder, "m").collect() == []
    with pytest.raises(KeyError):
        models.load(spark, folder, "m")
    models.save(spark, models.fit_linear(table, "y", ["a"]), folder, "m")
    assert models.save(spark, models.fit_linear(table, "y", ["b"]), folder, "m") == 2
    assert models.load(spark, folder, "m").columns == ["b"] and models.load(spark, folder, "m", 1).columns == ["a"]
    assert models.digest(table, XS) == models.digest(table.orderBy("id"), XS) != models.digest(table.where("id > 0"), XS)
    table.write.parquet(f"{folder}/in")
    assert models.batch_predict(spark, folder, "m", f"{folder}/in", f"{folder}/out", version=1) == 1
    assert {r.model_version for r in spark.read.parquet(f"{folder}/out").collect()} == {1}


def test_positional_split_and_choice(spark, table):
    held = sorted(r.id for r in models.positional_split(table, ["id"]).where("held_out").collect())
    assert held == list(range(320, 401))
    told = {r.model: r for r in models.choose_model(table, "y", XS, ["id"], families=True).collect()}
    assert set(told) == {"linear", "mean", "ridge", "tree"} and told["linear"].verdict == "strong" and told["mean"].verdict == "baseline"
    assert told["linear"].r2 > told["mean"].r2 and sum(r.chosen for r in told.values()) == 1
    noise = table.selectExpr("id", "y", "CAST(hash(id) % 100 AS DOUBLE) AS a")
    refused = {r.model: r for r in models.choose_model(noise.where("id >= 200"), "y", ["a"], ["id"]).collect()}
    assert refused["linear"].verdict == "weak"


def test_explained_fit(spark, table):
    rows = models.explain_fit(table, "y", XS, ["id"]).orderBy("rank").collect()
    assert [r.feature for r in rows] == ["a", "b", "c"] and [r.direction for r in rows] == ["up", "down", "up"] and rows[0].magnitude == "large" and rows[2].magnitude == "moderate"
    assert models.explain_fit(table.where("id < 4"), "y", XS, ["id"]).collect() == []


def test_shapley_values_add_up(spark, table):
    for kind, model in fitted(table).items():
        told = models.shapley_values(table, model, table, permutations=4, most=16)
        scores = {r.id: r.prediction for r in models.score(table, model).collect()}
        for r in told.collect():
            if r.id == 400:
                assert r.shapley is None
            else:
                assert r.base + sum(r.shapley) == pytest.approx(scores[r.id])
    linear = fitted(table)["linear"]
    mean = table.where("a is not null").selectExpr("avg(a) AS a", "avg(b) AS b", "avg(c) AS c")
    m = mean.first()
    for r in models.shapley_values(table.where("id < 5"), linear, mean).collect():
        assert r.shapley == pytest.approx([w * (v - u) for w, v, u in zip(linear.arrays["coefficients"], (r.a, r.b, r.c), m)])


def test_shapley_values_are_predicted_for_many_rows_at_once():
    rng, calls = np.random.default_rng(4), []
    x, base = rng.normal(size=(500, 3)), rng.normal(size=(7, 3))

    def predict(rows):
        calls.append(len(rows))
        return rows[:, 0] * rows[:, 1] + rows[:, 2]

    orders = [np.array(o) for o in ([0, 1, 2], [2, 1, 0], [1, 0, 2], [2, 0, 1])]
    known = predict(base).mean()
    want = np.zeros(x.shape)
    for row, told in zip(x, want):
        for order in orders:
            now, before = base.copy(), known
            for c in order:
                now[:, c] = row[c]
                told[c] += (predict(now).mean() - before) / len(orders)
                before = predict(now).mean()
    calls.clear()
    assert models._shares(predict, x, base, orders, known) == pytest.approx(want)
    assert len(calls) <= 2**3
