"""Session, table and graph helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..scratch import discard, materialise, shared_dir

__all__ = ["components", "discard", "materialise", "shared_dir", "table", "text_hash", "whole_id"]


def text_hash(text: str) -> Column:
    """What tells rows with one id apart, wherever and however often they are read."""
    return F.xxhash64(F.lit(3), F.col(text))


def whole_id(docs: DataFrame, doc_id: str) -> Column:
    """The id as a long, null as the least one; ids that aren't whole numbers are refused."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} is {kind.simpleString()}; this operator takes whole numbers as ids")
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, label: str = "links", limit: int = 100) -> DataFrame:
    """Connected components of links ``a``-``b`` (long): rows ``node, component``.

    The component is its smallest node. Alternates two contractions: every node
    hands its larger neighbours to its smallest neighbour, then its smaller ones.
    Both are a min aggregate (combined before the shuffle) joined back on the node.
    The aggregates are written first: both sides of the joins are then plain
    exchanges, whose hot keys the adaptive planner can split. Rounds grow with the
    logarithm of the longest chain; a round's tables go when the next one's are written.
    Nodes without a link are absent. An empty input gives an empty result.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialise(links, label)
    seen = None
    for _ in range(limit):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = materialise(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), label)
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        before, links = links, materialise(small.where("u <> v").distinct(), label)
        discard(before, least, large, lowest)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    rooted = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rooted.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
