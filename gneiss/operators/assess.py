"""Whole-table assessments: profile and quality with their issues, validity, uniqueness, compliance, row-wise outliers, causes of all pairs of columns."""

from __future__ import annotations

from itertools import combinations_with_replacement, permutations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered, profile, quality, windows
from gneiss.operators.regress import correlation_matrix
from gneiss.session import cut


def _counts(df: DataFrame) -> DataFrame:
    """One row: rows, missing cells, cells, duplicate rows, bytes of the rows as JSON."""
    missing = sum((F.count_if(stats.is_missing(F.col(f"`{c}`"))) for c in df.columns), F.lit(0))
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("long").alias("missing"), size.alias("json_bytes"))
    kinds = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.lit(1).alias("one")).agg(F.count("one").alias("kinds"))
    both = row.crossJoin(kinds)  # a row each
    return both.select("rows", F.lit(len(df.columns)).alias("columns"), (F.col("rows") * len(df.columns)).alias("cells"), "missing", (F.col("rows") - F.col("kinds")).alias("duplicates"), "json_bytes")


def table_profile(df: DataFrame) -> DataFrame:
    """(rows, columns, cells, missing, duplicates, json_bytes, quality): 0.6 of completeness and 0.4 of uniqueness, in percent; an empty table has quality 0."""
    score = F.round(100 * (0.6 * (1 - F.try_divide(F.col("missing"), F.col("cells"))) + 0.4 * (1 - F.try_divide(F.col("duplicates"), F.col("rows")))))
    return _counts(df).withColumn("quality", F.coalesce(score, F.lit(0.0)).cast("int"))


def table_quality(df: DataFrame) -> DataFrame:
    """(completeness, uniqueness, validity, score) as shares and percent; validity lacks the missing cells of columns that are over half empty."""
    sparse = [F.count_if(stats.is_missing(F.col(f"`{c}`"))) for c in df.columns]
    lost = df.agg(sum((F.when(m > F.count(F.lit(1)) * 0.5, m).otherwise(0) for m in sparse), F.lit(0)).alias("__lost"))
    row = _counts(df).crossJoin(lost).where("rows > 0")  # a row each
    completeness, uniqueness, validity = (1 - F.col(a) / F.col(b) for a, b in (("missing", "cells"), ("duplicates", "rows"), ("__lost", "cells")))
    # fixed values: weights; consistency counts as whole
    score = F.round(100 * (0.35 * completeness + 0.2 * uniqueness + 0.3 * validity + 0.15)).cast("int")
    return row.select(completeness.alias("completeness"), uniqueness.alias("uniqueness"), validity.alias("validity"), score.alias("score"))


def quality_issues(df: DataFrame) -> DataFrame:
    """(severity, category, column, detail) of what stands out: missing cells, copies, skewed, sparse and nearly unique columns; an empty table is one issue."""
    counts = _counts(df)
    gaps, copies = F.col("missing") / F.col("cells"), F.col("duplicates") / F.col("rows")

    def issue(severity: Column, category: str, detail: Column) -> Column:
        return F.struct(severity.alias("severity"), F.lit(category).alias("category"), F.lit(None).cast("string").alias("column"), detail.cast("double").alias("detail"))

    # fixed values: limits of the rules
    whole = F.array(
        F.when(F.col("rows") == 0, issue(F.lit("critical"), "empty", F.lit(0.0))),
        F.when(F.try_divide(F.col("missing"), F.col("cells")) > 0.05, issue(F.when(gaps > 0.2, "critical").otherwise("warning"), "completeness", gaps)),
        F.when(F.col("duplicates") > 0, issue(F.when(copies > 0.1, "critical").otherwise("warning"), "uniqueness", copies)),
    )
    table = counts.select(F.explode(F.array_compact(whole)).alias("x")).select("x.*")
    cards = cut(windows.column_cards(df, df.columns))
    sparse = cards.where("missing > 0.5 * rows").select(F.lit("critical"), F.lit("sparse_column"), "column", F.col("missing") / F.col("rows"))
    unique = cards.where("type = 'categorical' and distinct > 0.95 * rows").select(F.lit("info"), F.lit("cardinality"), "column", F.col("distinct").cast("double"))
    numeric = [r.column for r in cards.where("type = 'numeric'").select("column").collect()]  # a row a column
    out = table.union(sparse).union(unique)
    if numeric:
        skews = df.agg(*[stats.skewness(stats.number(F.col(f"`{c}`"))).alias(f"s{k}") for k, c in enumerate(numeric)])
        told = skews.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{k}").alias("skew")) for k, c in enumerate(numeric)])).alias("x")).select("x.*")
        out = out.union(told.where("abs(skew) > 2").select(F.lit("info"), F.lit("distribution"), "column", "skew"))
    return out


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct, present, cardinality_pct, is_key, is_low, score): columns whose present values are all different, those under 5 percent, and 100 less twice the percent of duplicate rows."""
    cards = windows.column_cards(df, columns)
    score = _counts(df).select(F.greatest(F.lit(0.0), 100 - 200 * F.coalesce(F.try_divide(F.col("duplicates"), F.col("rows")), F.lit(0.0))).alias("score"))
    present = F.col("rows") - F.col("missing")
    share = F.coalesce(F.try_divide(F.col("distinct") * 100, present), F.lit(0.0))
    return cards.crossJoin(F.broadcast(score)).select("column", "distinct", present.alias("present"), share.alias("cardinality_pct"), (F.col("distinct") == present).alias("is_key"), (share < 5).alias("is_low"), "score")


#: Classes that count as valid beside the commonest class of a column.
_FITS = {"integer": ("integer", "float"), "float": ("integer", "float"), "date": ("date",), "email": ("email",), "url": ("url",)}


def validity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dominant, invalid, validity_pct, status): present values that are not of the commonest class of their column; texts and booleans are always valid."""
    classes = quality._pairs(df, columns).select("column", quality.value_class(F.col("value")).alias("class")).where("class is not null").groupBy("column", "class").agg(F.count("*").alias("n"))
    best = classes.groupBy("column").agg(F.min_by("class", F.struct(-F.col("n"), "class")).alias("dominant"), F.sum("n").alias("present"))
    fits = F.coalesce(*[F.when(F.col("dominant") == k, F.col("class").isin(*v)) for k, v in _FITS.items()], F.lit(True))
    told = classes.join(best, "column").groupBy("column", "dominant", "present").agg(F.sum(F.when(fits, 0).otherwise(F.col("n"))).alias("invalid"))
    pct = (1 - F.col("invalid") / F.col("present")) * 100
    # fixed values: limits of the status
    return told.select("column", "dominant", "invalid", pct.alias("validity_pct"), F.when(pct < 70, "critical").when(pct < 95, "warning").otherwise("good").alias("status"))


# Weights of kinds of personal data, levels of risk, and what each framework holds sensitive.
RISK_WEIGHTS = {
    "ssn": 30, "credit_card": 30, "iban": 25, "email": 15, "phone": 12, "date_of_birth": 15,
    "address": 10, "name": 8, "gender": 5, "race": 20, "religion": 20, "ip_address": 8,
}
FRAMEWORKS = {
    "GDPR": ("ssn", "race", "religion", "health", "biometric"),
    "CCPA": ("ssn", "credit_card", "iban"),
    "HIPAA": ("name", "email", "phone", "date_of_birth", "address"),
    "PCI-DSS": ("credit_card",),
}


def privacy_risk(found: DataFrame) -> DataFrame:
    """(score, level) of findings (column, kind) of personal data: the sum of their weights, 100 at most."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in RISK_WEIGHTS.items()], F.lit(5))
    s = F.col("score")
    return found.agg(F.least(F.lit(100), F.coalesce(F.sum(weight), F.lit(0))).cast("int").alias("score")).withColumn("level", F.when(s > 70, "critical").when(s > 40, "high").when(s > 20, "medium").otherwise("low"))


def compliance(found: DataFrame) -> DataFrame:
    """(framework, findings, status, columns): compliant without a sensitive finding, to be reviewed with one or two, else not compliant."""
    told = found.agg(*[F.count_if(F.col("kind").isin(*kinds)).alias(f"n{k}") for k, kinds in enumerate(FRAMEWORKS.values())], *[F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("column")))).alias(f"c{k}") for k, kinds in enumerate(FRAMEWORKS.values())])
    cells = []
    for k, name in enumerate(FRAMEWORKS):
        n = F.col(f"n{k}")
        status = F.when(n == 0, "compliant").when(n > 2, "non_compliant").otherwise("review_required")
        cells.append(F.struct(F.lit(name).alias("framework"), n.alias("findings"), status.alias("status"), F.array_join(f"c{k}", ",").alias("columns")))
    return told.select(F.explode(F.array(*cells)).alias("x")).select("x.*")  # as many rows as frameworks


# Limits of the three rules by sensitivity (z-score, quartile distances, modified z-score).
SENSITIVITY = {"low": (3.5, 2.5, 3.5), "medium": (2.5, 1.8, 2.5), "high": (1.8, 1.5, 2.0)}


def row_anomalies(df: DataFrame, id_cols: list[str], columns: list[str], sensitivity: str = "medium") -> DataFrame:
    """(ids, column, value, reasons, score, severity): cells that a rule finds; the score is the highest excess over a rule's limit, 3 at most.

    Columns without a deviation, a quartile distance or a median deviation skip that
    rule, but any value off the median counts where the median deviation is 0.
    """
    z_limit, fence, m_limit = SENSITIVITY[sensitivity]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), stats.number(F.col(f"`{c}`")).alias("value")) for c in columns])).alias("x")
    long = cut(df.select(*id_cols, cells).select(*id_cols, "x.*").where("value is not null"))
    spread = long.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    quartiles = ordered.quantiles(long, ["column"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select("column", "q1", "q2", "q3")
    known = spread.join(quartiles, "column")  # a row a column
    rows = long.join(F.broadcast(known), "column")
    mad = ordered.quantiles(rows.withColumn("away", F.abs(F.col("value") - F.col("q2"))), ["column"], "away", {"mad": 0.5}).select("column", "mad")
    rows = rows.join(F.broadcast(mad), "column")  # a row a column
    z = F.when(F.col("sd") > 0, F.abs(F.col("value") - F.col("m")) / F.col("sd"))
    gap = F.col("q3") - F.col("q1")
    outside = (gap > 0) & ((F.col("value") < F.col("q1") - fence * gap) | (F.col("value") > F.col("q3") + fence * gap))
    away = F.abs(F.col("value") - F.col("q2"))
    mz = 0.6745 * away / F.when(F.col("mad") > 0, F.col("mad")).otherwise(1e-9)
    by = {"z": F.when(z > z_limit, z / z_limit), "iqr": F.when(outside, away / gap / fence), "mad": F.when(mz > m_limit, mz / m_limit)}
    score = F.least(F.lit(3.0), F.greatest(*by.values(), F.lit(0.0)))
    told = rows.select(*id_cols, "column", "value", F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in by.items()])), ",").alias("reasons"), score.alias("score")).where("reasons <> ''")
    s = F.col("score")
    return told.withColumn("severity", F.when(s >= 2.5, "critical").when(s >= 1.8, "high").when(s >= 1.2, "medium").otherwise("low"))


def p_band(r: Column, n: Column) -> Column:
    """The band of the p-value of a correlation by its t; n/a below three values."""
    t = F.abs(r * F.sqrt(n - 2) / F.greatest(F.sqrt(F.greatest(1 - r * r, F.lit(0.0))), F.lit(1e-9)))
    return F.when(n < 3, "n/a").when(t > 4, "<0.001").when(t > 3, "<0.01").when(t > 2, "<0.05").otherwise(">0.05")


def causal_pairs(df: DataFrame, series: list[str], order: str, columns: list[str], least: float = 0.3, critical: float = 3.84, most: int | None = 20) -> DataFrame:
    """(series, cause, effect, r, p, strength, slope, r2, f, improvement_pct, causal, improves, confidence): ordered pairs of columns that move together.

    f compares the effect's AR(1) with and without the cause's value before; causal is an
    f above ``critical``, improves one above 4 that also lowers the squared error by over
    5 percent.  One window and one aggregate serve all pairs.  ``most`` cuts the list of
    each series.
    """
    w = Window.partitionBy(*series).orderBy("__t")
    rows = df.select(*series, F.col(order).alias("__t"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    rows = rows.select("*", *[F.lag(f"x{k}").over(w).alias(f"b{k}") for k in range(len(columns))])
    sums = []
    for a, b in permutations(range(len(columns)), 2):
        whole = F.col(f"b{a}").isNotNull() & F.col(f"b{b}").isNotNull() & F.col(f"x{b}").isNotNull()
        y, u, v = (F.when(whole, F.col(c)) for c in (f"x{b}", f"b{b}", f"b{a}"))
        sums += [stats.correlation(F.col(f"x{a}"), F.col(f"x{b}")).alias(f"r{a}_{b}"), F.count_if(F.col(f"x{a}").isNotNull() & F.col(f"x{b}").isNotNull()).alias(f"n{a}_{b}")]
        sums += [F.regr_slope(f"x{b}", f"x{a}").alias(f"s{a}_{b}"), F.count(y).alias(f"k{a}_{b}")]
        sums += [(F.covar_pop(p, q) * F.count(y)).alias(f"{name}{a}_{b}") for name, p, q in (("yy", y, y), ("uu", u, u), ("vv", v, v), ("yu", y, u), ("yv", y, v), ("uv", u, v))]
    if len(columns) < 2:
        raise ValueError("a pair needs two columns")
    found = rows.groupBy(*series).agg(*sums)
    cells = []
    for a, b in permutations(range(len(columns)), 2):
        yy, uu, vv, yu, yv, uv, k = (F.col(f"{x}{a}_{b}") for x in ("yy", "uu", "vv", "yu", "yv", "uv", "k"))
        det = uu * vv - uv * uv
        alone = yy - F.try_divide(yu * yu, uu)
        rest = alone.cast("double") - F.coalesce(F.try_divide((yv * uu - yu * uv) * (yv * uu - yu * uv), uu * det), F.lit(0.0))
        f = F.when((rest > 1e-12) & (k >= 4), (alone - rest) / (rest / (k - 3))).otherwise(0.0)
        better = F.greatest(F.coalesce(F.try_divide(alone - rest, alone), F.lit(0.0)) * 100, F.lit(0.0))
        cells.append(F.struct(F.lit(columns[a]).alias("cause"), F.lit(columns[b]).alias("effect"), F.col(f"r{a}_{b}").alias("r"), F.col(f"n{a}_{b}").alias("n"), F.col(f"s{a}_{b}").alias("slope"), f.alias("f"), better.alias("improvement_pct")))
    pairs = found.select(*series, F.explode(F.array(*cells)).alias("c")).select(*series, "c.*").where(F.abs("r") >= least)
    size, causal = F.abs("r"), F.col("f") > critical
    told = pairs.select(
        *series, "cause", "effect", "r", p_band(F.col("r"), F.col("n")).alias("p"), F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak").alias("strength"), "slope", (F.col("r") * F.col("r")).alias("r2"), "f",
        "improvement_pct", causal.alias("causal"), ((F.col("f") > 4) & (F.col("improvement_pct") > 5)).alias("improves"), (size * F.when(causal, 1.2).otherwise(0.8)).alias("confidence"),
    )
    if most is None:
        return told
    place = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc("confidence"), "cause", "effect"))  # as many rows a series as pairs of columns
    return told.withColumn("__k", place).where(F.col("__k") <= most).drop("__k")


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """df with all products of two to ``degree`` of the columns, powers included, named like ``a^2`` and ``a*b``; a null factor makes a null."""
    new = {}
    for d in range(2, degree + 1):
        for parts in combinations_with_replacement(columns, d):
            powers = {c: parts.count(c) for c in dict.fromkeys(parts)}
            new["*".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())] = prod((F.col(f"`{c}`").cast("double") for c in parts[1:]), start=F.col(f"`{parts[0]}`").cast("double"))
    return df.withColumns(new)


def correlation_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, column, r) of a whole heat map: both halves, and 1 on the diagonal."""
    upper = cut(correlation_matrix(df, columns).select("a", "b", "r"))
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return upper.union(upper.select("b", "a", "r")).union(own).toDF("row", "column", "r")


def distribution(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(measure, value): the statistics of a numeric column; else its number of distinct values and how often the k commonest stand there."""
    if column in profile.numeric_columns(df):
        row = profile.numeric_profile(df, [column])
        names = ["count", "min", "q1", "median", "q3", "max", "mean", "stdev"]
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    top = profile.top_values(df, [column], k).select(F.concat(F.lit("n:"), "value").alias("measure"), F.col("n").cast("double").alias("value"))
    kinds = df.where(~stats.is_missing(F.col(f"`{column}`"))).agg(F.count_distinct(f"`{column}`").cast("double").alias("value")).select(F.lit("distinct").alias("measure"), "value")
    return top.union(kinds)
