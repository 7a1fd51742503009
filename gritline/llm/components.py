"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritline.operators.skew import FEW, apart, salted_join, stage


def _downward(links: DataFrame) -> DataFrame:
    """Links as distinct (a, b) with a > b."""
    return (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _with_least(links: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Links with the least node ``m`` around ``a``; it goes to every task only if links are few."""
    return links.join(F.broadcast(least), "a") if few else salted_join(links, apart(least), ["a"], ["b"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for each node that has links.

    ``links`` has bigint columns ``a`` and ``b`` in any order, repeated or not; a link of a node to
    itself is none. Large star links every neighbour above a node to the smallest one around it,
    small star does so below; both keep the components, and after a number of rounds that grows
    with the logarithm of the longest path, each node is linked to its root alone. Links never
    leave Spark; a node with many of them is split over salts in the joins, which move both sides unless links are few.
    """
    now = stage(_downward(links))
    mark = _checksum(now)
    while mark[0]:
        few = mark[0] <= FEW
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        upper = _with_least(both.where("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(_downward(upper))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = _with_least(large, least, few).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(_downward(lower.union(least.select("a", F.col("m").alias("b")))))
        before, mark = mark, _checksum(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
