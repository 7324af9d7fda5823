"""How many nodes lie within two moves of each of many searches, without a row for every pair that meets at a hub.

All relations are of numbers. A search holds the nodes of its first move
(src, m), and each of those lists what it reaches (m, t). Hubs, which a large
share of the searches hold, are bits of a word: a search has a word of the hubs
that it holds, a node a word of the hubs that list it, and both meet if the words
share a bit. Few different words are compared, not searches with nodes; what no
hub brings together is found pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch

#: Hubs, as many as bits of a word at most; one search in SHARE holds each of them, or more.
HUBS, SHARE = 62, 16


@dataclass
class Balls:
    """near: (src, v), of(t): (t, u), the words of searches and nodes; rest: (src, t) of pairs that no hub brings together, None without any."""

    near: DataFrame
    of: DataFrame
    rest: DataFrame | None

    def sizes(self) -> DataFrame:
        """(src, n): how many nodes each search reaches."""
        words = self.near.select("v").distinct().crossJoin(self.of.groupBy("u").agg(F.count("*").alias("_n")))
        met = words.groupBy("v").agg(F.sum(F.when(meet(), F.col("_n")).otherwise(0)).alias("n"))
        sizes = self.near.join(met, "v").select("src", "n")
        if self.rest is None:
            return sizes
        more = self.rest.groupBy("src").agg(F.count("*").alias("_more"))
        return sizes.join(more, "src", "left").select("src", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"))


def meet() -> Column:
    """Whether the words of a search and of a node share a hub."""
    return F.col("v").bitwiseAND(F.col("u")) != 0


def two_moves(searches: DataFrame, nodes: DataFrame, first: DataFrame, lists: DataFrame) -> Balls:
    """The balls of searches (src) in nodes (t); first: (src, m), lists: (m, t), both with the nodes themselves, rows may repeat."""
    spark, n = searches.sparkSession, searches.count()
    held = first.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") * SHARE >= n).orderBy(F.col("n").desc(), "m").limit(HUBS)
    bits = [(r["m"], 1 << k) for k, r in enumerate(held.collect())]
    hubs = F.broadcast(spark.createDataFrame(bits, "m int, bit long"))

    def words(every: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
        found = rows.join(hubs, "m").groupBy(key).agg(F.bit_or("bit").alias(name))
        return scratch.keep(every.join(found, key, "left").select(key, F.coalesce(name, F.lit(0).cast("long")).alias(name)), "words", fewer=True)

    near, of = words(searches, first, "src", "v"), words(nodes, lists, "t", "u")
    apart = scratch.keep(near.select("v").distinct().crossJoin(of.select("u").distinct()).where(~meet()), "apart", fewer=True)
    if apart.isEmpty():
        return Balls(near, of, None)
    # only searches and nodes of such words can meet otherwise
    lone = scratch.keep(near.join(apart.select("v").distinct(), "v", "left_semi"), "words", fewer=True)
    far = scratch.keep(lists.join(scratch.keep(of.join(apart.select("u").distinct(), "u", "left_semi"), "words", fewer=True), "t").join(hubs, "m", "left_anti"), "lists", fewer=True)
    rest = first.join(lone, "src").join(far, "m").where(~meet()).select("src", "t").distinct()
    return Balls(near, of, scratch.keep(rest, "rest", fewer=True))
