"""Mixing sources to target weights, with DataFrame operations alone.

The words of every source are summed, targets follow from the sources' weights,
and target over size is the source's repetition rate. A document is emitted
floor(rate) times, and once more with probability rate - floor(rate), decided by
a hash of its id and a seed. Shares grow by water filling: a source's target
never exceeds `most` times its size, and what is above goes to the others by
weight until none is above.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; rows with the same doc_id get the same decision, and each row
counts; a source without words has target 0 and its documents are not taken;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgraph import scratch

#: Up to so many sources, their targets are broadcast (some 50 bytes each); above, documents are joined over salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn. One row a
    source enters the windows, after partial sums on every task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    # in order of size / weight, sources are capped up to some place; the level is the share of a unit of weight beyond it
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)),
            "total": F.sum("source_size").over(everything),
            "rest": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    cap = F.col("source_size") * F.lit(float(most))
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    by = by.withColumn("level", F.when(level * F.col("w") < cap, level)).withColumn("level", F.max("level").over(everything))
    share = F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap))
    return by.select("source", "source_size", share.alias("target"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """docs(doc_id, source, _size, ...) with _source_size, _target and _copies added."""
    plan = scratch.keep(targets(docs.select("source", F.col("_size").alias("size")), weights, most), "targets", fewer=True)
    plan = plan.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if plan.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")), "left")
    else:
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = docs.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt")), "left").drop("_own", "_salt")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(chance(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("long")
    return joined.drop("_source").withColumn("_copies", copies)


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies and taken = size * copies."""
    sizes = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size")), "sizes")
    out = with_copies(sizes, seed)
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document's row as often as it is taken, columns as they came."""
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("_size"))
    taken = with_copies(packed, seed).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


#: DuckDB's form of mix_report over the table documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3.0::DOUBLE AS capped,
    sum(source_size) OVER ()::DOUBLE AS total,
    sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (
  SELECT max(CASE WHEN (total - capped) / rest * w < source_size * 3.0::DOUBLE THEN (total - capped) / rest END) AS level FROM o),
t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce(level * w, source_size * 3.0::DOUBLE)) AS target FROM o, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM c
"""
