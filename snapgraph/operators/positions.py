"""Places of rows in an order, without bringing them together.

Rows are sorted over all partitions and written once, each with its partition and
its number within; a prefix sum over the partitions' sizes, of which there are as
many as partitions, makes places of both. As the written table lies in order, a
page of it is found by its files' statistics, without sorting again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgraph import scratch

_PART, _NTH = 33, (1 << 33) - 1


def number(df: DataFrame, by: list[Column], place: str = "place", weight: Column | None = None, before: str = "before") -> DataFrame:
    """df in the order of `by`, with its place from 0; with a weight also the sum of the weights of all rows before it.

    Rows that are equal in `by` get places of their own, in an order that is
    fixed once written.
    """
    sorted_ = df.withColumn("_weight", F.lit(0) if weight is None else weight).orderBy(*by)
    kept = scratch.keep(sorted_.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, nth = F.shiftright("_id", _PART), F.col("_id").bitwiseAND(F.lit(_NTH))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_sum"))
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(place, F.col("_start") + nth)
    if weight is not None:
        own = F.sum("_weight").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(before, F.col("_sum") + F.coalesce(own, F.lit(0)))
    return out.select(*df.columns, place, *([before] if weight is not None else []))


def index(df: DataFrame, by: list[Column], place: str = "place") -> DataFrame:
    """What `number` gives, written in order, so that `page` reads few files of it."""
    return scratch.keep(number(df, by, place), "indexed")


def page(indexed: DataFrame, start: int, rows: int, place: str = "place") -> DataFrame:
    """The rows at places from start on, in order."""
    return indexed.where(F.col(place).between(start, start + rows - 1)).orderBy(place)
