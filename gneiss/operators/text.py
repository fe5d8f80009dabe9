"""Sentiment, keywords and personal data in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import stats

# Sentiment and emotion lexicons.
POSITIVE = "good great excellent amazing wonderful fantastic love best happy perfect awesome brilliant positive success win gain profit up high".split()
NEGATIVE = "bad terrible awful horrible worst hate sad angry fail loss down low negative poor disappointing broken wrong error crash".split()
EMOTIONS = {
    "joy": "happy joy delighted excited pleased glad".split(),
    "anger": "angry furious irritated annoyed mad outraged".split(),
    "sadness": "sad depressed unhappy miserable down blue".split(),
    "fear": "afraid scared worried anxious nervous terrified".split(),
    "surprise": "surprised shocked amazed astonished unexpected".split(),
    "trust": "trust reliable honest faithful loyal dependable".split(),
}

# Patterns and weights of personal data.
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"(?:\+?(\d{1,3}))?[-. (]*(\d{3})[-. )]*(\d{3})[-. ]*(\d{4})",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "creditCard": r"\b(?:\d[ -]*?){13,16}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}
PII_WEIGHTS = {"ssn": 30, "creditCard": 30, "passport": 25, "iban": 20, "email": 15, "phone": 15, "ip": 10}


def words(col: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.split(F.lower(F.coalesce(col, F.lit(""))), r"\s+")


def _hits(tokens: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*lexicon)))


def sentiment(df: DataFrame, text_col: str, id_cols: list[str]) -> DataFrame:
    """Score (positive - negative) / words and its label at +-0.05 for each row."""
    tokens = words(F.col(text_col))
    base = df.select(*id_cols, tokens.alias("__t"))
    score = (_hits(F.col("__t"), POSITIVE) - _hits(F.col("__t"), NEGATIVE)) / F.size("__t")
    out = base.select(*id_cols, F.round(score, 6).alias("score"))
    return out.withColumn("label", F.when(F.col("score") > 0.05, "positive").when(F.col("score") < -0.05, "negative").otherwise("neutral"))


def emotion_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Words of each emotion over all texts."""
    tokens = df.select(words(F.col(text_col)).alias("t"))
    totals = tokens.agg(*[F.sum(_hits(F.col("t"), lexicon)).alias(e) for e, lexicon in EMOTIONS.items()])
    pairs = F.array(*[F.struct(F.lit(e).alias("emotion"), F.coalesce(F.col(e), F.lit(0)).alias("n")) for e in EMOTIONS])
    return totals.select(F.explode(pairs).alias("x")).select("x.*")


def keywords(df: DataFrame, text_col: str, longer_than: int = 3, k: int = 20) -> DataFrame:
    """The k most frequent words longer than ``longer_than``; ties by word."""
    token = df.select(F.explode(words(F.col(text_col))).alias("word")).where(F.length("word") > longer_than)
    return token.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def pii_matches(df: DataFrame, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows that match each pattern in each column, over all rows."""
    patterns = patterns or PII_PATTERNS
    found = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(p)).alias(f"{c}__{k}") for c in columns for k, p in patterns.items()])
    items = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"{c}__{k}").alias("matches"), F.col("rows")) for c in columns for k in patterns]
    out = found.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    return out.withColumn("found", F.col("matches") > 0.1 * F.col("rows"))


def pii_risk(matches: DataFrame) -> DataFrame:
    """Risk score (at most 100), level and compliance from pii_matches."""
    weight = F.element_at(F.create_map(*[x for k, v in PII_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    total = F.coalesce(F.sum(F.when(F.col("found"), F.coalesce(weight, F.lit(5)))), F.lit(0))
    has = {k: F.coalesce(F.max(F.when(F.col("found"), F.col("kind") == k)), F.lit(False)) for k in ("ssn", "creditCard")}
    out = matches.agg(total.alias("raw"), has["ssn"].alias("ssn"), has["creditCard"].alias("card"))
    law = F.when(F.col("raw") > 30, "non-compliant").otherwise("likely-compliant")
    return out.select(
        F.least("raw", F.lit(100)).cast("int").alias("risk_score"),
        F.when(F.col("raw") > 50, "high").when(F.col("raw") > 20, "medium").otherwise("low").alias("risk_level"),
        law.alias("gdpr"), law.alias("ccpa"),
        F.when(F.col("ssn"), "non-compliant").otherwise("n/a").alias("hipaa"), F.when(F.col("card"), "non-compliant").otherwise("n/a").alias("pci_dss"),
    )


def mask(col: Column, kind: str) -> Column:
    """A value with its private part hidden."""
    text = col.cast("string")
    last4 = F.right(text, F.lit(4))
    return {
        "email": F.concat(F.left(text, F.lit(1)), F.lit("***@"), F.substring_index(text, "@", -1)),
        "phone": F.concat(F.left(text, F.lit(3)), F.lit("***"), F.right(text, F.lit(2))),
        "ssn": F.concat(F.lit("***-**-"), last4),
        "creditCard": F.concat(F.lit("**** **** **** "), last4),
        "name": F.concat(F.left(text, F.lit(1)), F.lit("***")),
        "ip": F.concat(F.substring_index(text, ".", 3), F.lit(".***")),
    }.get(kind, F.lit("***REDACTED***"))


def text_features(df: DataFrame, text_col: str, id_cols: list[str]) -> DataFrame:
    """Lengths and counts of words, upper, lower, digit and special characters."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def count(pattern):
        return F.regexp_count(t, F.lit(pattern)).cast("bigint")

    n_words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))).cast("bigint")
    return df.select(
        *id_cols, F.length(t).cast("bigint").alias("length"), n_words.alias("word_count"), count("[A-Z]").alias("upper"), count("[a-z]").alias("lower"), count("[0-9]").alias("digit"),
        count(r"[^A-Za-z0-9\s]").alias("special"),
    )


def normalize_text(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[^\w\s]", "")


def valid_share(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """Percent of present values of each column that fit each anchored pattern."""
    items = []
    for c in columns:
        for k, p in patterns.items():
            present = ~stats.is_missing(F.col(c))
            items.append((c, k, F.count_if(present & F.col(c).cast("string").rlike(p)), F.count_if(present)))
    row = df.agg(*[x.alias(f"{c}__{k}__{n}") for c, k, *pair in items for n, x in enumerate(pair)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("pattern"), F.round(F.col(f"{c}__{k}__0") * 100 / F.col(f"{c}__{k}__1"), 4).alias("valid_pct")) for c, k, *_ in items]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


# Words that turn the sentiment of the next word.
NEGATORS = "not no never none nobody nothing neither nor without hardly".split()


def sentiment_negated(df: DataFrame, text_col: str, id_cols: list[str]) -> DataFrame:
    """tanh(score / sqrt(words)) over word tokens; after a negator a positive word counts -0.75 and a negative one +0.5."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(\w+)"), F.lit(1))

    def worth(t: Column, k: Column) -> Column:
        turned = (k > 0) & F.try_element_at("__t", k.cast("int")).isin(*NEGATORS)
        up = F.when(turned, -0.75).otherwise(1.0)
        down = F.when(turned, 0.5).otherwise(-1.0)
        return F.when(t.isin(*POSITIVE), up).when(t.isin(*NEGATIVE), down).otherwise(0.0)

    base = df.select(*id_cols, tokens.alias("__t"))
    total = F.aggregate(F.transform("__t", worth), F.lit(0.0), lambda s, v: s + v)
    score = F.when(F.size("__t") > 0, F.tanh(total / F.sqrt(F.size("__t")))).otherwise(0.0)
    out = base.select(*id_cols, F.round(score, 6).alias("score"))
    return out.withColumn("label", F.when(F.col("score") > 0.1, "positive").when(F.col("score") < -0.1, "negative").otherwise("neutral"))
