"""Fitted models as versioned tables, one scoring path for all of them, choice among models, and Shapley values.

A model is plain numbers: its kind, its columns and named arrays, with the number of
rows it was fitted on and a digest of them.  Saved models are rows of a Parquet
table in a folder of their name and version; what is scored by a version can be
traced to it.  Linear models and k-means are scored by column expressions, forests by
Arrow batches of flat node arrays.  Rows with a null in a model's columns get a null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import ml, ordered, regress
from gneiss.session import cut

_SAVED = "kind string, columns array<string>, arrays map<string, array<double>>, rows long, digest string"
#: Numbers that a batch of Shapley values lays before the model at once.
_AT_ONCE = 1 << 18


@dataclass
class Model:
    kind: str
    columns: list[str]
    arrays: dict[str, list[float]]
    rows: int = 0
    digest: str = ""
    version: int | None = field(default=None, compare=False)


def digest(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """(rows, digest) of some columns, whatever the order of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return row.n, f"{int(row.s or 0) % (1 << 64):016x}"


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def fit_linear(df: DataFrame, y: str, xs: list[str]) -> Model:
    """Least squares with intercept."""
    found = {r.term: r.coefficient for r in regress.ols(df, y, xs).collect()}
    return Model("linear", xs, {"intercept": [found["intercept"]], "coefficients": [found[x] for x in xs]}, *digest(_complete(df, [y, *xs]), [y, *xs]))


def fit_kmeans(df: DataFrame, columns: list[str], k: int = 3, seed: int = 1) -> Model:
    fitted = KMeans(featuresCol="__features", k=k, seed=seed).fit(ml._vectors(df, columns))
    centres = np.array(fitted.clusterCenters())
    return Model("kmeans", columns, {"centres": centres.ravel().tolist(), "k": [float(len(centres))]}, *digest(_complete(df, columns), columns))


def fit_forest(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 1) -> Model:
    """Isolation trees over a sample of at most four times ``sample`` rows, chosen by a hash of their values."""
    rows = _complete(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns)
    base = rows.orderBy(F.xxhash64(F.lit(seed), *columns)).limit(sample * 4).toPandas().to_numpy()
    if not len(base):
        raise ValueError("a forest needs a row to grow on")
    return Model("forest", columns, flat_trees(ml.plant(base, trees, sample, seed)) | {"size": [float(min(sample, len(base)))]}, *digest(rows, columns))


def flat_trees(nested: list) -> dict[str, list[float]]:
    """Trees as arrays of nodes: feature (-1 in a leaf), threshold, the node below and above, depth added; and the roots."""
    feature, threshold, below, above, added, roots = [], [], [], [], [], []

    def put(node) -> int:
        at = len(feature)
        inner = isinstance(node, tuple)
        for column, value in zip((feature, threshold, below, above, added), (node[0], node[1], 0, 0, 0.0) if inner else (-1, 0.0, at, at, node)):
            column.append(float(value))
        if inner:
            below[at], above[at] = float(put(node[2])), float(put(node[3]))
        return at

    for tree in nested:
        roots.append(float(put(tree)))
    return {"feature": feature, "threshold": threshold, "below": below, "above": above, "added": added, "roots": roots}


def forest_scores(arrays: dict[str, list[float]]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows to isolation scores, all rows and trees a level at a time."""
    feature, below, above, roots = (np.array(arrays[c], np.int64) for c in ("feature", "below", "above", "roots"))
    threshold, added, usual = np.array(arrays["threshold"]), np.array(arrays["added"]), max(ml.average_path(int(arrays["size"][0])), 1e-9)

    def score(x: np.ndarray) -> np.ndarray:
        at = np.tile(roots, (len(x), 1))
        depth = np.zeros(at.shape)
        while (inner := feature[at] >= 0).any():
            left = np.take_along_axis(x, np.maximum(feature[at], 0), axis=1) < threshold[at]
            depth += inner
            at = np.where(inner, np.where(left, below[at], above[at]), at)
        return 2 ** (-(depth + added[at]).mean(axis=1) / usual) if len(x) else np.zeros(0)

    return score


def predictor(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """The model as a function of a matrix."""
    if model.kind == "linear":
        return lambda x: model.arrays["intercept"][0] + x @ np.array(model.arrays["coefficients"])
    if model.kind == "kmeans":
        centres = np.array(model.arrays["centres"]).reshape(int(model.arrays["k"][0]), -1)
        return lambda x: ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1).astype(float)
    return forest_scores(model.arrays)


def score(df: DataFrame, model: Model, out: str = "prediction") -> DataFrame:
    """df with the model's prediction: a value, the nearest centre, or an isolation score."""
    xs = [F.col(f"`{c}`").cast("double") for c in model.columns]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
    if model.kind == "linear":
        made: Column = F.lit(model.arrays["intercept"][0]) + reduce(lambda a, b: a + b, [F.lit(b) * x for b, x in zip(model.arrays["coefficients"], xs)])
    elif model.kind == "kmeans":
        centres = np.array(model.arrays["centres"]).reshape(int(model.arrays["k"][0]), -1).tolist()
        away = [F.struct(sum(((x - F.lit(v)) * (x - F.lit(v)) for x, v in zip(xs, c)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
        made = F.array_min(F.array(*away))["k"].cast("double")
    else:
        arrays = model.arrays

        def make() -> Callable[[np.ndarray], np.ndarray]:
            run = forest_scores(arrays)
            return lambda x: run(np.asarray(x, float).reshape(len(x), -1))

        batched = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=2048, input_tensor_shapes=[[len(xs)]])
        made = batched(F.array(*[F.coalesce(x, F.lit(0.0)) for x in xs]))
    return df.withColumn(out, F.when(whole, made))


def versions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(version, kind, columns, arrays, rows, digest) of all saved versions of a name."""
    try:
        return spark.read.schema(f"{_SAVED}, version int").parquet(f"{folder}/{name}").select("version", "kind", "columns", "arrays", "rows", "digest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"version int, {_SAVED}")


def save(spark: SparkSession, model: Model, folder: str, name: str) -> int:
    """The model as the next version of a name; an earlier version is never written over."""
    version = 1 + (versions(spark, folder, name).agg(F.max("version").alias("v")).first().v or 0)
    row = (model.kind, model.columns, model.arrays, model.rows, model.digest)
    spark.createDataFrame([row], _SAVED).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{name}/version={version}")
    return version


def load(spark: SparkSession, folder: str, name: str, version: int | None = None) -> Model:
    """A version of a name, the last without a number."""
    rows = versions(spark, folder, name)
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if found is None:
        raise KeyError(f"no model {name}" + (f" of version {version}" if version else ""))
    return Model(found.kind, list(found.columns), {k: list(v) for k, v in found.arrays.items()}, found.rows, found.digest, found.version)


def batch_predict(spark: SparkSession, folder: str, name: str, source: str, destination: str, version: int | None = None) -> int:
    """Scores a Parquet table into another, with the version beside each prediction; returns the version."""
    model = load(spark, folder, name, version)
    score(spark.read.parquet(source), model).withColumn("model_version", F.lit(model.version)).write.mode("overwrite").parquet(destination)
    return model.version


def positional_split(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """df with ``held_out``: false for the first share of the rows in an order, true for the rest."""
    placed = ordered.numbered(df, [], order, "__place")
    size = placed.agg(F.count(F.lit(1)).alias("__n"))
    return placed.crossJoin(F.broadcast(size)).withColumn("held_out", F.col("__place") >= F.floor(F.col("__n") * share)).drop("__place", "__n")


def _errors(rows: DataFrame, y: str, predictions: dict[str, Column]) -> list:
    """One aggregate with R2 and mean absolute error of each prediction."""
    t = F.col(y).cast("double")
    found = rows.agg(F.var_pop(t).alias("v"), *[F.avg((t - p) * (t - p)).alias(f"s_{n}") for n, p in predictions.items()], *[F.avg(F.abs(t - p)).alias(f"a_{n}") for n, p in predictions.items()]).first()
    return [(n, 1 - found[f"s_{n}"] / found.v if found.v else 0.0, found[f"a_{n}"] or 0.0) for n in predictions if found[f"s_{n}"] is not None]


def choose_model(df: DataFrame, y: str, xs: list[str], order: list[str], share: float = 0.8, families: bool = False, seed: int = 1) -> DataFrame:
    """(model, r2, mae, verdict, chosen) on the last rows of an order, fitted on the first: least squares against their mean.

    With ``families`` regularised lines and trees join in, each with its parameters
    chosen by a split of the first rows.  Chosen is the highest R2, of equal ones the
    first by name; a table whose mean is best has no model worth its name.
    """
    rows = cut(positional_split(_complete(df, [y, *xs]), order, share))
    train, test = rows.where("not held_out"), rows.where("held_out")
    mean = train.agg(F.avg(y).alias("m")).first().m
    if mean is None:
        raise ValueError("no complete row to fit on")
    line = fit_linear(train, y, xs)
    tested = score(test, line, "__line")
    columns = {"linear": F.col("__line"), "mean": F.lit(float(mean))}
    if families:
        target, spread = "__target", ml._vectors(train, xs).withColumn("__target", F.col(y).cast("double"))
        tested = ml._vectors(tested, xs)
        for name, learner, grid in (
            ("ridge", LinearRegression(featuresCol="__features", labelCol=target, predictionCol="__ridge"), {"regParam": [0.01, 0.1, 1.0]}),
            ("tree", DecisionTreeRegressor(featuresCol="__features", labelCol=target, predictionCol="__tree", seed=seed), {"maxDepth": [2, 4, 6]}),
        ):
            build = ParamGridBuilder()
            for parameter, values in grid.items():
                build = build.addGrid(learner.getParam(parameter), values)
            judge = RegressionEvaluator(labelCol=target, predictionCol=f"__{name}", metricName="rmse")
            best = TrainValidationSplit(estimator=learner, estimatorParamMaps=build.build(), evaluator=judge, trainRatio=0.8, parallelism=3, seed=seed).fit(spread)
            tested = best.bestModel.transform(tested)
            columns[name] = F.col(f"__{name}")
    found = _errors(tested, y, columns)
    top = min(found, key=lambda f: (-f[1], f[0]))[0] if found else None
    # fixed values: limits of the verdicts
    told = [(n, float(r2), float(mae), "baseline" if n == "mean" else "strong" if r2 > 0.7 else "acceptable" if r2 > 0.4 else "weak", n == top) for n, r2, mae in found]
    return df.sparkSession.createDataFrame(told, "model string, r2 double, mae double, verdict string, chosen boolean")


def explain_fit(df: DataFrame, y: str, xs: list[str], id_cols: list[str], top: int = 5) -> DataFrame:
    """(feature, importance, rank, coefficient, direction, magnitude) of the ``top`` features of a least-squares fit; fewer than five complete rows explain nothing."""
    rows = cut(_complete(df, [y, *xs]))
    if len(rows.limit(5).collect()) < 5:
        return rows.sparkSession.createDataFrame([], "feature string, importance double, rank int, coefficient double, direction string, magnitude string")
    fit = regress.ols(rows, y, xs).select(F.col("term").alias("feature"), "coefficient")
    found = regress.permutation_importance(rows, y, xs, id_cols).join(fit, "feature").where(F.col("rank") <= top)
    size = F.abs("coefficient")
    return found.withColumns({"direction": F.when(F.col("coefficient") > 0, "up").otherwise("down"), "magnitude": F.when(size < 0.1, "small").when(size < 1, "moderate").otherwise("large")})


def _shares(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray, base: np.ndarray, orders: list[np.ndarray], known: float) -> np.ndarray:
    """What each column of some rows adds, averaged over orders; a set of columns is predicted once, however many orders pass it."""
    values, means = np.zeros(x.shape), {}
    for order in orders:
        before: float | np.ndarray = known
        for k, c in enumerate(order):
            taken = sorted(order[: k + 1].tolist())
            if (key := tuple(taken)) not in means:
                now = np.repeat(base[None], len(x), axis=0)
                now[:, :, taken] = x[:, None, taken]
                means[key] = predict(now.reshape(-1, base.shape[1])).reshape(len(x), len(base)).mean(axis=1)
            values[:, c] += means[key] - before
            before = means[key]
    return values / len(orders)


def shapley_values(df: DataFrame, model: Model, background: DataFrame, permutations: int = 8, most: int = 64, seed: int = 1, out: str = "shapley") -> DataFrame:
    """df with an array of what each column adds to the prediction, against at most ``most`` rows of a background, and base, its mean prediction.

    Columns take a row's values one after another in drawn orders and their reverses; what
    each step adds is averaged over orders and background rows.  The values of a row
    always add up to its prediction less the base.
    """
    base = np.array(_complete(background.select(*[F.col(c).cast("double") for c in model.columns]), model.columns).orderBy(F.xxhash64(F.lit(seed), *model.columns), *model.columns).limit(most).toPandas(), float)
    if not len(base):
        raise ValueError("the background has no complete row")
    rng = np.random.default_rng(seed)
    half = [rng.permutation(len(model.columns)) for _ in range((permutations + 1) // 2)]
    orders = [o for p in half for o in (p, p[::-1])]
    known = float(predictor(model)(base).mean())
    step = max(1, _AT_ONCE // base.size)
    kept = [c for c in df.columns if c not in (out, "base")]
    rows = df.select(*kept, F.array(*[F.col(f"`{c}`").cast("double") for c in model.columns]).alias("__x"))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model)
        for batch in batches:
            column = batch.column("__x").to_pylist()
            whole = [k for k, x in enumerate(column) if not any(v is None for v in x)]
            told: list[list[float] | None] = [None] * len(column)
            for at in range(0, len(whole), step):
                own = whole[at : at + step]
                for k, values in zip(own, _shares(predict, np.array([column[k] for k in own], float), base, orders, known).tolist()):
                    told[k] = values
            arrays = [batch.column(c) for c in kept] + [pa.array(told, pa.list_(pa.float64())), pa.array([known] * len(told), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, out, "base"])

    return rows.mapInArrow(run, schema)
