"""Rows by a part of their name, through an index of trigrams.

The index holds, for every run of three characters of the lower-case names, the
rows that have it, in order of the trigram and with Bloom filters, so a look-up
reads few row groups; and how many rows each trigram has. A part is looked for
by its rarest trigram alone: what that one lists is read and verified, so the
work follows the rarest trigram's rows, not the relation's. Parts of less than
three characters have no trigram and are looked for in all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.operators.rounds import sized_join

#: Parts for which trigrams are pushed down to the index as a list; more are joined with it.
LISTED = 1000


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters; none if there are fewer characters."""
    n = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


@dataclass
class Index:
    """postings: (gram, id, name_lc) in order of gram; counts: (gram, n); names: (id, name_lc)."""

    postings: DataFrame
    counts: DataFrame
    names: DataFrame


def build(rows: DataFrame) -> Index:
    """The index of (id, name)."""
    names = scratch.keep(rows.select("id", F.lower("name").alias("name_lc")).where("name_lc is not null"), "names")
    grams = names.select(F.explode(trigrams(F.col("name_lc"))).alias("gram"), "id", "name_lc")
    # ranges of (gram, id), so that a frequent trigram is spread over files
    postings = scratch.keep(grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"), "postings", options={"parquet.bloom.filter.enabled#gram": "true", "parquet.block.size": str(8 << 20)})
    return Index(postings, scratch.keep(postings.groupBy("gram").agg(F.count("*").alias("n")), "grams", fewer=True), names)


def find(index: Index, wanted: DataFrame) -> DataFrame:
    """(wanted, id): the rows whose name holds each wanted text, case ignored, white space around it left out; empty ones find nothing."""
    asked = wanted.select("wanted").distinct().withColumn("part", F.lower(F.trim("wanted"))).where("part <> ''")
    asked = scratch.keep(asked.withColumn("grams", trigrams(F.col("part"))), "asked")
    unfolded = asked.select("wanted", "part", F.explode("grams").alias("gram"))
    rarest = unfolded.join(index.counts, "gram", "left").groupBy("wanted", "part").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
    # a part with a trigram that no name has is in no name
    rarest = scratch.keep(rarest.where("r.n is not null").select("wanted", "part", "r.gram", "r.n"), "rarest")
    postings = index.postings
    grams = [r["gram"] for r in rarest.select("gram").distinct().limit(LISTED + 1).collect()]
    if len(grams) <= LISTED:
        postings = postings.where(F.col("gram").isin(grams))
    per = scratch.keep(rarest.groupBy("gram").agg(F.first("n").alias("n"), F.collect_list(F.struct("wanted", "part")).alias("asked")), "per")
    met = sized_join(postings, per, "gram", "n").select("id", "name_lc", F.explode("asked").alias("q"))
    long = met.where(F.contains("name_lc", F.col("q.part"))).select("q.wanted", "id")
    short = asked.where(F.size("grams") == 0)
    if short.isEmpty():
        return long
    few = F.broadcast(short.select("wanted", "part"))  # of one or two characters each
    return long.union(index.names.join(few, F.contains("name_lc", F.col("part"))).select("wanted", "id"))
