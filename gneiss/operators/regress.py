"""Correlation, regression, causal and test statistics from sums gathered in one pass."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered
from gneiss.operators.timeseries import _over


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair over pairwise complete rows, with strength and collinearity; one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.coalesce(stats.correlation(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{k}", 6).alias("r")) for k, (a, b) in enumerate(pairs)])
    out = row.select(F.explode(cells).alias("x")).select("x.*")
    strength = F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").when(F.abs("r") > 0.3, "weak").otherwise("none")
    return out.select("a", "b", "r", strength.alias("strength"), (F.abs("r") > 0.8).alias("collinear"))


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    return ordered.spearman(df, a, b, group)


def simple_ols(df: DataFrame, y: str, x: str, group: list[str] | None = None) -> DataFrame:
    """Slope, intercept, R2 and residual standard error."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    s = rows.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("__syy"), F.regr_sxy(y, x).alias("__sxy"),
    )
    se = F.sqrt(F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0)) / (F.col("n") - 2))
    return s.withColumn("std_error", se).drop("__syy", "__sxy")


def _normal_equations(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'y and (n, sum y, sum y2) of the complete rows, from one aggregate of k x k sums."""
    rows = df.dropna("any", subset=[y, *xs])
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    target = F.col(y).cast("double")
    found = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))] + [F.sum(c * target) for c in cols] + [F.count("*"), F.sum(target), F.sum(target * target)]
    row = [float(v or 0) for v in rows.agg(*[f.alias(f"s{k}") for k, f in enumerate(found)]).first()]
    k = len(cols)
    xtx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = row[at]
            at += 1
    return xtx, np.array(row[at : at + k]), np.array(row[at + k :])


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient, r2, n) of the least-squares fit with intercept; k x k work on the driver."""
    xtx, xty, (n, sy, syy) = _normal_equations(df, y, xs)
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    total = syy - sy * sy / max(n, 1)
    r2 = float((beta @ xty - sy * sy / max(n, 1)) / total) if total > 0 else 0.0
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(t, float(b), r2, int(n)) for t, b in zip(["intercept", *xs], beta)], "term string, coefficient double, r2 double, n long")


def linear_shap(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Mean absolute contribution beta (x - mean) of each feature over all complete rows, with its rank."""
    beta = {r.term: r.coefficient for r in ols(df, y, xs).collect()}
    rows = df.dropna("any", subset=[y, *xs])
    means = rows.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(xs)]).first()
    row = rows.agg(*[F.avg(F.abs(F.lit(beta[x]) * (F.col(x) - F.lit(means[k])))).alias(f"c{k}") for k, x in enumerate(xs)])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"c{k}").alias("importance")) for k, x in enumerate(xs)])).alias("x")).select("x.*")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row per feature


def _t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    value, terms = 1.0, 200
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    return 1 / value


def welch_test(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Welch's t, degrees of freedom n1 + n2 - 2, pooled Cohen's d with its band, and the p-value."""
    a, b = F.when(F.col(group) == first, F.col(value)), F.when(F.col(group) == second, F.col(value))
    r = df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).first()
    t = (r.m0 - r.m1) / math.sqrt(r.v0 / r.n0 + r.v1 / r.n1)
    free = r.n0 + r.n1 - 2
    d = (r.m0 - r.m1) / math.sqrt(((r.n0 - 1) * r.v0 + (r.n1 - 1) * r.v1) / free)
    size = abs(d)
    band = "large" if size >= 0.8 else "medium" if size >= 0.5 else "small" if size >= 0.2 else "negligible"
    return df.sparkSession.createDataFrame([(t, int(free), d, band, _t_tail(abs(t), free))], "t double, df long, cohen_d double, effect string, p_value double")


def granger(df: DataFrame, series: list[str], order: str, cause: str, effect: str, critical: float = 3.84) -> DataFrame:
    """F of the effect's AR(1) with against without the cause's lag, from sums of one pass."""
    w = _over(series, order)
    rows = df.select(*series, F.col(effect).cast("double").alias("y"), F.lag(effect).over(w).cast("double").alias("u"), F.lag(cause).over(w).cast("double").alias("v")).where("y is not null and u is not null and v is not null")
    s = rows.groupBy(*series).agg(
        F.count("*").alias("n"), *[(F.covar_pop(a, b) * F.count("*")).alias(a + b) for a, b in ("yy", "uu", "vv", "yu", "yv", "uv")]
    )
    restricted = F.col("yy") - F.col("yu") * F.col("yu") / F.col("uu")
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    b = (F.col("yu") * F.col("vv") - F.col("yv") * F.col("uv")) / det
    c = (F.col("yv") * F.col("uu") - F.col("yu") * F.col("uv")) / det
    full = F.col("yy") - b * F.col("yu") - c * F.col("yv")
    stat = F.when((full > 0) & (F.col("n") >= 4), (restricted - full) / (full / (F.col("n") - 3))).otherwise(0.0)
    return s.select(*series, "n", stat.alias("f"), (stat > critical).alias("causal"))


def what_if(df: DataFrame, target: str, causes: list[str], change: float = 0.1) -> DataFrame:
    """Expected change of the target's mean if a cause's mean moves by ``change``."""
    row = df.agg(F.avg(target).alias("mt"), *[F.regr_slope(F.col(target).cast("double"), F.col(c).cast("double")).alias(f"b{k}") for k, c in enumerate(causes)], *[F.avg(c).alias(f"m{k}") for k, c in enumerate(causes)])
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), (F.col(f"b{k}") * F.col(f"m{k}") * change).alias("effect"), "mt") for k, c in enumerate(causes)])
    return row.select(F.explode(cells).alias("x")).select("x.cause", "x.effect", (F.col("x.effect") / F.col("x.mt") * 100).alias("effect_pct"))


def partial_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each pair given all other columns, from the inverse of the correlation matrix."""
    r = {(x.a, x.b): x.r for x in correlation_matrix(df, columns).collect()}
    m = np.array([[1.0 if a == b else r.get((a, b), r.get((b, a))) for b in columns] for a in columns])
    inv = np.linalg.pinv(m)
    rows = [(columns[i], columns[j], float(-inv[i, j] / math.sqrt(inv[i, i] * inv[j, j]))) for i, j in combinations(range(len(columns)), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, partial double")


def permutation_importance(df: DataFrame, y: str, xs: list[str], id_cols: list[str], seed: int = 1) -> DataFrame:
    """Loss of R2 when one feature's values are dealt to other rows, by the fit on the real ones; with ranks."""
    rows = df.dropna("any", subset=[y, *xs])
    beta = {r.term: r.coefficient for r in ols(rows, y, xs).collect()}
    line = F.lit(beta["intercept"]) + sum((F.lit(beta[x]) * F.col(x) for x in xs), F.lit(0.0))
    total = rows.agg(F.var_pop(F.col(y)).alias("v")).first().v
    base = 1 - rows.agg(F.avg((F.col(y) - line) ** 2).alias("e")).first().e / total
    found = []
    for k, x in enumerate(xs):
        # neighbours in a hash order swap values, within as many groups as there are shuffle partitions or more
        w = Window.partitionBy(F.pmod(F.xxhash64(F.lit(seed + k), *id_cols), F.lit(4096))).orderBy(F.xxhash64(F.lit(seed + 50 + k), *id_cols))
        moved = rows.withColumn(x, F.coalesce(F.lag(x).over(w), F.last(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        found.append((x, base - (1 - moved.agg(F.avg((F.col(y) - line) ** 2).alias("e")).first().e / total)))
    order = sorted(found, key=lambda f: (-f[1], f[0]))
    return df.sparkSession.createDataFrame([(x, float(v), n + 1) for n, (x, v) in enumerate(order)], "feature string, importance double, rank int")
