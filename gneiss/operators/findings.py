"""Ranking and review of findings, analysis plans, columns side by side, personal data by names and patterns, market measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered

# Weights of impact, and what keeps a finding that is not of high impact.
IMPACT = {"high": 3, "medium": 2, "low": 1}
KEPT_MEDIUM, KEPT_OTHER, PREFIX = 0.7, 0.85, 40


def _impact(column: str = "impact") -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in IMPACT.items()], F.lit(0))


def relevant_findings(findings: DataFrame, most: int | None = 7) -> DataFrame:
    """(place, title, impact, confidence, category): findings worth telling, by impact, then confidence, then title.

    High impact stays; medium above 0.7 confidence; an overview if it is the very first
    of all; others above 0.85.  Of titles with the same beginning (40 letters, in any
    case) the first stays.  ``most`` cuts the list.
    """
    order = [F.desc("__w"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("title")]
    rows = findings.select("title", "impact", "confidence", "category", _impact().alias("__w"))
    first = rows.orderBy(*order).limit(1).select(F.col("title").alias("__first"))  # a row
    told = rows.crossJoin(F.broadcast(first))
    overview = (F.col("category") == "overview") & (F.col("title") == F.col("__first"))
    kept = (
        F.when(F.col("impact") == "high", True)
        .when((F.col("impact") == "medium") & (F.col("confidence") > KEPT_MEDIUM), True)
        .when(F.col("category") == "overview", overview)
        .otherwise(F.coalesce(F.col("confidence") > KEPT_OTHER, F.lit(False)))
    )
    key = F.struct((-F.col("__w")).alias("w"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "title", "impact", "confidence", "category")
    best = told.where(kept).groupBy(F.substring(F.lower("title"), 1, PREFIX).alias("__start")).agg(F.min(key).alias("x")).select("x.*")
    few = best.orderBy("w", "c", "title") if most is None else best.orderBy("w", "c", "title").limit(most)
    return ordered.numbered(few, [], ["w", "c", "title"]).select((F.col("place") + 1).alias("place"), "title", "impact", "confidence", "category")


def review(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """(weak, contradictions, success_rate, score) of findings (title, confidence) and the runs (status) behind them.

    Weak is a confidence below 0.3; titles that tell of rises and others that tell of
    falls contradict each other, which counts once.  Each issue takes 5 off the share of
    runs that succeeded, in percent; never below 0.
    """
    title = F.lower("title")
    up, down = (F.coalesce(F.max(title.rlike(p).cast("int")), F.lit(0)) for p in ("up|increase", "down|decrease"))
    many = F.count_if(title.rlike("trend|increase|decrease|up|down")) > 1
    told = findings.agg(F.count_if(F.col("confidence") < 0.3).alias("weak"), (many & (up == 1) & (down == 1)).cast("long").alias("contradictions"))
    rate = runs.agg(F.coalesce(F.avg((F.col("status") == "success").cast("int")), F.lit(0.0)).alias("success_rate"))
    both = told.crossJoin(rate)  # a row each
    return both.withColumn("score", F.greatest(F.lit(0.0), F.col("success_rate") * 100 - 5 * (F.col("weak") + F.col("contradictions"))))


def concat_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both side by side by their places in their orders; the shorter one is filled with nulls, a repeated name gets ``_right``."""
    a, b = ordered.numbered(left, [], left_order, "__place"), ordered.numbered(right, [], right_order, "__place")
    taken = {c.lower() for c in left.columns}
    b = b.select("__place", *[F.col(f"`{c}`").alias(f"{c}_right" if c.lower() in taken else c) for c in right.columns])
    return a.join(b, "__place", "full").drop("__place")


def analysis_plan(cards: DataFrame, target: DataFrame) -> DataFrame:
    """(step, analysis, methodology) that the types of a table's columns call for; cards as of column_cards, target as of target_column."""
    kinds = cards.agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("numeric", "categorical", "datetime")], F.max("rows").alias("rows"))
    known = target.agg((F.count("*") > 0).alias("target"))
    row = kinds.crossJoin(known)  # a row each
    aimed = F.col("target")
    # fixed values: analyses in their order, and when each is due
    due = [
        ("Descriptive Statistics", F.lit(True)),
        ("Correlation Analysis", F.col("numeric") >= 2),
        ("Multiple Linear Regression", aimed & (F.col("numeric") >= 2)),
        ("Time Series Analysis", aimed & (F.col("datetime") > 0)),
        ("K-Means Clustering", (F.col("numeric") >= 2) & (F.col("rows") > 50)),
        ("Group Comparison", aimed & (F.col("categorical") > 0)),
    ]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in due]))
    whole = F.when(F.size("a") > 3, "comprehensive").otherwise("targeted")
    steps = row.select(listed.alias("a")).withColumn("methodology", whole).select("methodology", F.posexplode("a").alias("step", "analysis"))
    return steps.select((F.col("step") + 1).alias("step"), "analysis", "methodology")


# What names tell of a column, and patterns of its values with the confidence of each.
PERSONAL_NAMES = {
    "name": ("name", "first_name", "last_name", "full_name", "username"),
    "email": ("email", "e-mail", "mail"),
    "phone": ("phone", "mobile", "tel", "telephone"),
    "address": ("address", "street", "city", "zip", "postal"),
    "ssn": ("ssn", "social_security", "national_id"),
    "date_of_birth": ("dob", "birth_date", "birthday", "date_of_birth"),
    "gender": ("gender", "sex"),
    "race": ("race", "ethnicity"),
    "religion": ("religion", "faith"),
}
PERSONAL_PATTERNS = {
    "email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.95),
    "phone": (r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", 0.7),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", 0.9),
    "credit_card": (r"\b(?:\d[ -]*?){13,16}\b", 0.6),
    "ip_address": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.85),
    "date_of_birth": (r"\b\d{4}-\d{2}-\d{2}\b", 0.4),
    "iban": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", 0.85),
}
NAME_CONFIDENCE, LEAST_SHARE = 0.85, 0.3


def personal_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, method, confidence, share): personal data by the name of a column, and by the first pattern that over 30 percent of its rows match.

    All rows count; missing values match nothing.
    """
    columns = columns or df.columns
    texts = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns}
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(texts[c].rlike(p)).alias(f"m{k}_{j}") for k, c in enumerate(columns) for j, (p, _) in enumerate(PERSONAL_PATTERNS.values())])
    cells: list[Column] = []
    for k, c in enumerate(columns):
        shares = [F.try_divide(F.col(f"m{k}_{j}"), F.col("n")) for j in range(len(PERSONAL_PATTERNS))]
        found = [F.when(s > LEAST_SHARE, F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.lit("pattern").alias("method"), F.lit(conf).alias("confidence"), s.alias("share"))) for s, (kind, (_, conf)) in zip(shares, PERSONAL_PATTERNS.items())]
        cells.append(F.coalesce(*found))
        named = next((kind for kind, parts in PERSONAL_NAMES.items() if any(p in c.lower() for p in parts)), None)
        if named:
            cells.append(F.struct(F.lit(c).alias("column"), F.lit(named).alias("kind"), F.lit("name").alias("method"), F.lit(NAME_CONFIDENCE).alias("confidence"), F.lit(None).cast("double").alias("share")))
    return counts.where("n > 0").select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")


def against_benchmark(df: DataFrame, keys: list[str], value: str, benchmark: float, threshold: float = 2.5) -> DataFrame:
    """(keys, n, total, mean, stdev, vs_benchmark_pct, anomalies): a measure beside a benchmark of its mean; anomalies lie beyond so many deviations."""
    v = stats.number(F.col(value))
    spread = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), stats.stdev(v).alias("stdev")).where("n > 0")
    rows = ordered.match(df.select(*keys, v.alias("__v")), spread.select(*keys, F.col("mean").alias("__m"), F.col("stdev").alias("__s")), keys)
    far = rows.groupBy(*keys).agg(F.count_if((F.col("__s") > 0) & (F.abs(F.col("__v") - F.col("__m")) / F.col("__s") > threshold)).alias("anomalies"))
    told = spread.withColumn("vs_benchmark_pct", (F.col("mean") / benchmark - 1) * 100)
    return ordered.match(told, far, keys)


def rate_moves(df: DataFrame, series: list[str], order: str, value: str, periods: int = 252) -> DataFrame:
    """(series, first, last, change_pct, spread_pct, yearly_pct, assessment): how a rate moves from value to value.

    spread_pct is the deviation of the percent changes, yearly_pct the root of their mean
    square over so many periods; from a value of 0 there is no change.
    """
    w = Window.partitionBy(*series).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(*series, F.col(order).alias("__t"), F.col(value).cast("double").alias("__v"), F.lag(F.col(value).cast("double")).over(w).alias("__b"))
    move = F.try_divide(F.col("__v") - F.col("__b"), F.col("__b"))
    told = rows.groupBy(*series).agg(
        F.min_by("__v", "__t").alias("first"), F.max_by("__v", "__t").alias("last"), stats.stdev(move * 100).alias("spread_pct"), (F.sqrt(F.avg(move * move) * periods) * 100).alias("yearly_pct"), F.count("*").alias("__n")
    ).where("__n > 1")
    # fixed values: limits of the assessment
    level = F.when(F.col("spread_pct") > 10, "high_volatility").when(F.col("spread_pct") > 5, "moderate_volatility").otherwise("stable")
    return told.select(*series, "first", "last", (F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100).alias("change_pct"), "spread_pct", "yearly_pct", level.alias("assessment"))


def calendar_pattern(df: DataFrame, keys: list[str], time: str, value: str, band: float = 0.15) -> DataFrame:
    """(keys, month, mean, n, seasonal, peak, low): calendar months, those off the mean of the monthly means by more than the band, the highest and the lowest (ties: the earlier month)."""
    months = df.where(F.col(time).isNotNull()).groupBy(*keys, F.month(time).alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where("n > 0")
    whole = months.groupBy(*keys).agg(F.avg("mean").alias("__m"), F.max_by("month", F.struct("mean", -F.col("month"))).alias("__hi"), F.min_by("month", F.struct("mean", "month")).alias("__lo"))
    told = ordered.match(months, whole, keys)
    return told.select(*keys, "month", "mean", "n", (F.abs(F.col("mean") - F.col("__m")) > F.col("__m") * band).alias("seasonal"), (F.col("month") == F.col("__hi")).alias("peak"), (F.col("month") == F.col("__lo")).alias("low"))
