"""Comparison of two snapshots: match, status, line counts, roll-up, duplicates.

A snapshot is a relation with key columns and name, content, size_bytes, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgraph.functions.difflines import diff_stats
from snapgraph.functions.text import n_lines
from snapgraph.schemas import IDENTICAL, MODIFIED, ONLY_A, ONLY_B, class_key

COUNTS = ("lines_added", "lines_removed", "lines_changed")


def first_wins(items: DataFrame, keys: list[str], order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the duplicates with the kept row's path: (items, duplicates)."""
    by = Window.partitionBy(*keys).orderBy(order)
    ranked = items.withColumns({"dup_rank": F.row_number().over(by), "kept_path": F.first("rel_path").over(by)})
    again = ranked.where("dup_rank > 1").select(*keys, "name", "kept_path", F.col("rel_path").alias("ignored_path"))
    return ranked.where("dup_rank = 1").drop("dup_rank", "kept_path"), again


def status_of(in_a: Column, in_b: Column, identical: Column) -> Column:
    return F.when(in_a & in_b, F.when(identical, IDENTICAL).otherwise(MODIFIED)).when(in_a, ONLY_A).otherwise(ONLY_B)


def match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match: keys, name (of a, else b), presence, contents, error flag and status."""

    def side(df: DataFrame, org: str) -> DataFrame:
        columns = {c: (df[c] if c in df.columns else F.lit(None).cast(t)) for c, t in (("name", "string"), ("content", "string"), ("size_bytes", "long"), ("error", "string"))}
        return df.select(*keys, F.lit(True).alias(f"in_org_{org}"), *[v.alias(f"{c}_{org}") for c, v in columns.items()])

    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    in_a, in_b = F.coalesce("in_org_a", F.lit(False)), F.coalesce("in_org_b", F.lit(False))
    # an unreadable file is never identical to anything; an empty error text is no error
    failed = F.coalesce(F.col("error_a") != "", F.lit(False)) | F.coalesce(F.col("error_b") != "", F.lit(False))
    same = in_a & in_b & ~failed & F.coalesce(F.col("content_a") == F.col("content_b"), F.lit(False))
    return both.select(
        *keys,
        F.coalesce("name_a", "name_b").alias("name"),
        status_of(in_a, in_b, same).alias("status"),
        in_a.alias("in_org_a"),
        in_b.alias("in_org_b"),
        same.alias("is_identical"),
        failed.alias("has_error"),
        "content_a",
        "content_b",
        "size_bytes_a",
        "size_bytes_b",
        "error_a",
        "error_b",
    )


def with_stats(matched: DataFrame) -> DataFrame:
    """Line counts; only modified rows reach the Python matcher, the others are counted natively."""
    lines_a, lines_b = n_lines(F.col("content_a")), n_lines(F.col("content_b"))
    zero = F.lit(0)
    removed = F.when(F.col("status") == ONLY_A, lines_a).otherwise(zero)
    added = F.when(F.col("status") == ONLY_B, lines_b).otherwise(zero)
    plain = matched.where(F.col("status") != MODIFIED).withColumns({"lines_added": added, "lines_removed": removed, "lines_changed": added + removed})
    counted = matched.where(F.col("status") == MODIFIED).withColumn("_stats", diff_stats("content_a", "content_b"))
    counted = counted.withColumns({c: F.col(f"_stats.{c}") for c in COUNTS}).drop("_stats")
    return plain.unionByName(counted)


def meta(compared: DataFrame, keys: list[str]) -> DataFrame:
    """The listing: no contents."""
    return compared.select(*keys, "name", "status", "in_org_a", "in_org_b", "is_identical", "has_error", *COUNTS)


def filtered(listing: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    """By exact status (an unknown one gives nothing) and case-insensitive part of the name, taken literally."""
    if status:
        listing = listing.where(F.col("status") == status)
    if q and q.strip():
        listing = listing.where(F.contains(F.lower("name"), F.lit(q.strip().lower())))
    return listing


def histogram(listing: DataFrame) -> DataFrame:
    """One row: total and the count of each status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (MODIFIED, IDENTICAL, ONLY_A, ONLY_B)]
    return listing.agg(F.count("*").alias("total"), *counts)


def roll_up(files: DataFrame, bundles_a: DataFrame, bundles_b: DataFrame) -> DataFrame:
    """Bundles from their files' comparison: bundle_key, name, status, file_count, summed counts, any error.

    bundles_a and bundles_b hold (bundle_key, name); a bundle without files on
    either side is identical if both have it.
    """
    by = files.groupBy("bundle_key").agg(
        F.count("*").alias("file_count"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.bool_or("has_error").alias("has_error"),
        F.bool_and(F.col("status") == IDENTICAL).alias("same"),
    )
    both = bundles_a.select("bundle_key", F.col("name").alias("name_a"), F.lit(True).alias("a")).join(
        bundles_b.select("bundle_key", F.col("name").alias("name_b"), F.lit(True).alias("b")), "bundle_key", "full_outer"
    )
    in_a, in_b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    same = in_a & in_b & F.coalesce("same", F.lit(True))
    return both.join(by, "bundle_key", "left").select(
        "bundle_key",
        F.coalesce("name_a", "name_b").alias("name"),
        status_of(in_a, in_b, same).alias("status"),
        in_a.alias("in_org_a"),
        in_b.alias("in_org_b"),
        same.alias("is_identical"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("has_error", F.lit(False)).alias("has_error"),
    )


def by_rank(listing: DataFrame) -> DataFrame:
    """Modified first, then one-sided, then identical, by column rank; names by locale within."""
    rank = F.when(F.col("status") == MODIFIED, 0).when(F.col("status") == ONLY_A, 1).when(F.col("status") == ONLY_B, 2).otherwise(3)
    return listing.withColumn("rank", rank).orderBy("rank", F.collate("name", "UNICODE_CI"), "name")


def duplicates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both snapshots' duplicates as one bag, tagged with the org."""
    return a.withColumn("org", F.lit("a")).unionByName(b.withColumn("org", F.lit("b")))


def detail(compared: DataFrame, wanted: str) -> DataFrame:
    """One class (key: see `schemas.class_key`) with both contents, its name in any case, with extension or without; no row if there is none."""
    return compared.where(F.col("key") == class_key(F.lit(wanted)))


def details(compared: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, ...): the class of each asked name, as `detail` finds it; names without one give no row."""
    return wanted.withColumn("key", class_key(F.col("wanted"))).join(compared, "key")
