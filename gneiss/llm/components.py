"""Connected components by distributed union-find.

The links are dealt into partitions of about LINKS, and each folds its own into
forests (union-find with path halving, a bounded number of nodes at a time), which
leaves about one link per node and partition.  Rounds of large-star and small-star
then hook the forests of several partitions together: every round groups by node with partial aggregation and joins the
minimum back, so a node with very many links is only a skewed join, which Spark
splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch

#: Links of a partition, and nodes of a forest that is held in memory.
LINKS = 250_000
NODES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def told():
        links = [(x, find(x)) for x in list(parent)]
        links = [(x, r) for x, r in links if x != r]
        for at in range(0, len(links), 50_000):
            yield pd.DataFrame(links[at : at + 50_000], columns=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield from told()
            parent.clear()
    yield from told()


def _star(links: DataFrame) -> DataFrame:
    """One large-star and one small-star over links (a, b) with b < a."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    hooked = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
    return hooked.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links (a, b) that is not a root; root is the smallest node reachable.

    Null ends and links of a node with itself are ignored; an empty table gives
    an empty result.  Nodes may have any ordered type.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    links = scratch.keep(links)
    parts = -(-links.count() // LINKS) or 1
    now = scratch.keep(links.coalesce(1).mapInPandas(_forest, f"a {kind}, b {kind}") if parts == 1 else links.repartition(parts).mapInPandas(_forest, f"a {kind}, b {kind}").distinct())
    scratch.drop(links)
    if parts == 1:  # one forest has all links
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = _state(now)
    while state[0]:
        after = scratch.keep(_star(now))
        scratch.drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
