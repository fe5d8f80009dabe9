"""URL filters (operator 4), DataFrame functions only.

Rules of host and path come first; where none fits, a URL is blocked if its
canonical form is listed.  The list is held as a blocked Bloom filter: a table of
64-bit blocks, each URL setting ``bits`` bits of one block.  It has about
``bits_per_url`` bits per listed URL.  Only URLs that pass it go on to an exact
join with the list, which removes the false positives; the others are never
shuffled.  The filter is broadcast if its checked size is at most
``broadcast_bytes`` and joined by shuffle otherwise.

Canonical form: host without a leading ``www.`` or ``m.``, then the path without
its final slash; scheme, port of the scheme, query and fragment do not count.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no
rule, is on no list and is allowed; repeated rows give repeated rows; an empty
list blocks nothing, an empty table gives an empty result; of fitting rules of one
length the first in the list wins; very long URLs are matched whole; columns made here
replace those of pages with their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch

#: (rule, verdict) of host and path; the longest that fits wins.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/$", "")))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as written; null if none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    found = F.lit(None).cast("string")
    for name, verdict in rules:
        found = F.when(rule == name, F.lit(verdict)).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column, bits: int) -> Column:
    second = F.xxhash64(F.lit("bits"), url)
    mask = F.lit(0)
    for k in range(bits):
        place = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_filter(listed: DataFrame, blocks: int, bits: int = 5) -> DataFrame:
    """(block, word) of a blocked Bloom filter of the column url of listed."""
    masks = listed.select(_block(F.col("url"), blocks).alias("block"), _mask(F.col("url"), bits).alias("mask"))
    return masks.groupBy("block").agg(F.bit_or("mask").alias("word"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", bits_per_url: int = 16, bits: int = 5, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; listed has the column url of canonical URLs."""
    scratch = Scratch(pages.sparkSession)
    known = scratch.keep(listed.select("url").where("url is not null").distinct())
    row = known.agg(F.count("*"), F.coalesce(F.sum(F.length("url")), F.lit(0))).first()
    blocks = max(64, -(-row[0] * bits_per_url // 64))
    bloom = bloom_filter(known, blocks, bits)
    if 32 * min(blocks, row[0]) <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    exact = known.select(F.col("url").alias("__listed"))
    if row[1] + 64 * row[0] <= broadcast_bytes // 8:
        exact = F.broadcast(exact)
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("__url", canonical_url(F.col("host"), F.col("path")))
    needs = F.col("rule").isNull() & F.col("__url").isNotNull()
    hit = seen.where(needs).join(bloom, _block(F.col("__url"), blocks) == F.col("block"), "left")
    passed = F.coalesce(F.col("word").bitwiseAND(_mask(F.col("__url"), bits)) == _mask(F.col("__url"), bits), F.lit(False))
    hit = hit.select(id_col, "host", "path", "rule", "__url", passed.alias("__passed"))
    possible = hit.where("__passed").join(exact, F.col("__url") == F.col("__listed"), "left")
    columns = [F.col(id_col), F.col("host"), F.col("path"), F.col("rule")]
    ruled = seen.where(~needs).select(*columns, F.coalesce(rule_verdict(F.col("rule"), rules), F.lit("allow")).alias("verdict"))
    clear = hit.where("not __passed").select(*columns, F.lit("allow").alias("verdict"))
    checked = possible.select(*columns, F.when(F.col("__listed").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(clear).unionByName(checked)


def junk_listing(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The list of the query: canonical URLs of pages whose title is a row of cells (holds `` | ``)."""
    title = F.regexp_extract(html_col, r"(?s)<title>([^<]*)</title>", 1)
    url = canonical_url(url_host(F.col(url_col)), url_path(F.col(url_col)))
    return pages.where(title.contains(" | ")).select(url.alias("url")).where("url is not null")
