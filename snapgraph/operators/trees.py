"""Comparison of two snapshots by content trees: digests are compared top down, contents are not.

A leaf is an item's digest, a group's digest is made of its leaves': of a
bundle's, or of those of a range of keys where items have no bundle. Groups that
are equal on both sides are settled without a look at their items; the items of
the others are matched by their digests. No content is shuffled for a status;
`contents` brings those of the items that are asked for, as a rule the modified
ones.

A leaf's digest is SHA-256 of the content. A group's is the number of its items
and two sums of hashes of (key, digest), so it is summed up within tasks and a
group may be as large as it likes. Keys are unique within a snapshot (see
`diff.first_wins`). Items that could not be read are equal to nothing, and so
are null contents: a group that holds one is never settled as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.functions.difflines import diff_stats
from snapgraph.functions.text import n_lines
from snapgraph.operators.diff import COUNTS, status_of
from snapgraph.schemas import IDENTICAL, MODIFIED

#: Items in a range of keys, about, where items have no bundle.
RANGE = 256
#: Keys whose contents are brought by a broadcast of the keys; more of them are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def leaves(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, digest, n_lines, failed): a snapshot without its contents; items: keys, name, content, and error where it is known."""
    failed = F.coalesce(F.col("error") != "", F.lit(False)) if "error" in items.columns else F.lit(False)
    return items.select(*keys, "name", F.unhex(F.sha2("content", 256)).alias("digest"), n_lines(F.col("content")).alias("n_lines"), failed.alias("failed"))


_ROOT = ("items", "even", "odd", "settled")


def roots(side: DataFrame, keys: list[str]) -> DataFrame:
    """(_group, items, even, odd, settled): a row a group; settled is false where an item has no digest or could not be read."""
    mark = [F.sum(F.xxhash64(F.lit(salt), *keys, "digest").cast("decimal(20,0)")).alias(salt) for salt in ("even", "odd")]
    sure = F.col("digest").isNotNull() & ~F.col("failed")
    return side.groupBy("_group").agg(F.count("*").alias("items"), *mark, F.bool_and(sure).alias("settled"))


def open_groups(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(_group) of the groups that are not equal on both sides, written."""
    both = roots(a, keys).join(roots(b, keys).withColumnsRenamed({c: f"{c}_b" for c in _ROOT}), "_group", "full_outer")
    equal = F.col("settled") & F.col("settled_b")
    for c in _ROOT[:3]:
        equal = equal & (F.col(c) == F.col(f"{c}_b"))
    return scratch.keep(both.where(~F.coalesce(equal, F.lit(False))).select("_group"), "open", fewer=True)


def _matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, org: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"in_org_{org}"), *[F.col(c).alias(f"{c}_{org}") for c in ("name", "digest", "n_lines", "failed")])

    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    in_a, in_b = F.coalesce("in_org_a", F.lit(False)), F.coalesce("in_org_b", F.lit(False))
    failed = F.coalesce("failed_a", F.lit(False)) | F.coalesce("failed_b", F.lit(False))
    same = in_a & in_b & ~failed & F.coalesce(F.col("digest_a") == F.col("digest_b"), F.lit(False))
    return both.select(
        *keys, F.coalesce("name_a", "name_b").alias("name"), status_of(in_a, in_b, same).alias("status"), in_a.alias("in_org_a"), in_b.alias("in_org_b"), same.alias("is_identical"), failed.alias("has_error"), "n_lines_a", "n_lines_b"
    )


def match(a: DataFrame, b: DataFrame, keys: list[str], group: list[str] | None = None, ranges: bool = False) -> DataFrame:
    """keys, name (of a, else b), status, presence, is_identical, has_error, n_lines_a and n_lines_b: the statuses of `diff.match`, of items under unique keys.

    group: the key columns that name a bundle, so that equal bundles are settled
    first. ranges: the same by ranges of the keys' hash, for snapshots without
    bundles that are alike but for few items. Without either all digests are
    matched in one step and nothing is written in between.
    """
    a, b = leaves(a, keys), leaves(b, keys)
    if not group and not ranges:
        return _matched(a, b, keys)
    a, b = scratch.keep(a, "leaves"), scratch.keep(b, "leaves")
    by = F.struct(*group) if group else F.pmod(F.xxhash64(*keys), F.lit(max(1, a.count() // RANGE)))
    a, b = a.withColumn("_group", by), b.withColumn("_group", by)
    unequal = open_groups(a, b, keys)
    few = F.broadcast(unequal) if unequal.count() <= BROADCAST_ROWS else unequal
    looked = _matched(a.join(few, "_group", "left_semi"), b.join(few, "_group", "left_semi"), keys)
    true, false = F.lit(True), F.lit(False)
    settled = a.join(few, "_group", "left_anti").select(*keys, "name", F.lit(IDENTICAL), true, true, true, false, "n_lines", "n_lines")
    return looked.union(settled)


def contents(wanted: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content_a, content_b) of the wanted keys, from both snapshots; contents of other items are only read past."""
    asked = scratch.keep(wanted.select(*keys), "wanted", fewer=True)
    few = asked.count() <= BROADCAST_ROWS

    def side(df: DataFrame, org: str) -> DataFrame:
        return df.join(F.broadcast(asked) if few else asked, keys, "left_semi").select(*keys, F.col("content").alias(f"content_{org}"))

    return side(a, "a").join(side(b, "b"), keys, "full_outer")


def with_stats(matched: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Line counts of a match: of one-sided items from their leaves, of modified ones from their contents."""
    kept = scratch.keep(matched, "matched")
    zero = F.lit(0)
    removed = F.when(F.col("in_org_a") & ~F.col("in_org_b"), F.coalesce("n_lines_a", zero)).otherwise(zero)
    added = F.when(F.col("in_org_b") & ~F.col("in_org_a"), F.coalesce("n_lines_b", zero)).otherwise(zero)
    plain = kept.where(F.col("status") != MODIFIED).withColumns({"lines_added": added, "lines_removed": removed, "lines_changed": added + removed})
    changed = kept.where(F.col("status") == MODIFIED)
    counted = contents(changed, a, b, keys).select(*keys, diff_stats("content_a", "content_b").alias("_stats"))
    counted = changed.join(counted, keys).withColumns({c: F.col(f"_stats.{c}") for c in COUNTS}).drop("_stats")
    return plain.unionByName(counted).drop("n_lines_a", "n_lines_b")
