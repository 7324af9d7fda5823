"""Comparison by content trees: the same rows as by contents, none of which is shuffled."""

import random

from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.operators import diff, trees

KIND = "bundle string, key string, name string, content string, error string"
KEYS = ["bundle", "key"]


def sides(spark, seed):
    """Bundles of files: equal ones, some with an edit, with null contents or errors, and one-sided ones; a bundle of many files."""
    random.seed(seed)
    a, b = [], []
    for n in range(40):
        for k in range(300 if n == 0 else random.randrange(1, 6)):
            row = [f"b{n}", f"f{k}", f"F{k}", random.choice(["", "x\ny\n", "same", f"{n} {k}"]), None]
            other = list(row)
            kind = random.randrange(8) if n % 3 else 9
            if kind == 0:
                other[3] += "\nmore"
            if kind == 1:
                row[3] = None
            if kind == 2:
                row[3] = other[3] = None
            if kind == 3:
                row[4] = "denied"
            if kind == 4:
                other[4], other[2] = "", "f other name"
            if kind != 5:
                a.append(tuple(row))
            if kind != 6:
                b.append(tuple(other))
    return spark.createDataFrame(a, KIND).repartition(3), spark.createDataFrame(b, KIND).repartition(5)


COLUMNS = [*KEYS, "name", "status", "in_org_a", "in_org_b", "is_identical", "has_error"]


def found(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_the_same_rows_as_by_contents(spark, monkeypatch):
    for seed in (1, 2):
        a, b = sides(spark, seed)
        want = found(diff.match(a, b, KEYS))
        assert found(trees.match(a, b, KEYS, ["bundle"])) == want
        assert found(trees.match(a, b, KEYS)) == want
        monkeypatch.setattr(trees, "RANGE", 4)
        assert found(trees.match(a, b, KEYS, ranges=True)) == want
        monkeypatch.setattr(trees, "BROADCAST_ROWS", 0)
        columns = [*COLUMNS, *diff.COUNTS]
        assert found(trees.with_stats(trees.match(a, b, KEYS, ["bundle"]), a, b, KEYS), columns) == found(diff.with_stats(diff.match(a, b, KEYS)), columns)
        monkeypatch.undo()


def test_equal_groups_are_settled_as_a_whole(spark):
    a, b = sides(spark, 3)
    x, y = (trees.leaves(s, KEYS).withColumn("_group", F.col("bundle")) for s in (a, b))
    opened = {r[0] for r in trees.open_groups(x, y, KEYS).collect()}
    apart = {r["bundle"] for r in diff.match(a, b, KEYS).where("status <> 'identical'").collect()}
    assert opened == apart and not any(int(g[1:]) % 3 == 0 for g in opened)


def test_no_shuffle_carries_contents(spark):
    folder = scratch.folder(spark)
    a, b = (s for s in sides(spark, 4))
    for name, s in (("a", a), ("b", b)):
        s.write.mode("overwrite").parquet(f"{folder}/trees-{name}")
    a, b = spark.read.parquet(f"{folder}/trees-a"), spark.read.parquet(f"{folder}/trees-b")
    for df in (trees.match(a, b, KEYS), trees.match(a, b, KEYS, ["bundle"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [i for i, line in enumerate(plan.split("\n")) if "Exchange" in line]
        lines = plan.split("\n")
        assert exchanges and not any("content" in lines[i + 1] and "sha2" not in lines[i + 1] for i in exchanges if i + 1 < len(lines))
    few = trees.match(a, b, KEYS).where("status = 'modified'")
    brought = trees.contents(few, a, b, KEYS)
    assert brought.count() == few.count()


def test_empty_sides(spark):
    a, b = sides(spark, 5)
    none = a.limit(0)
    for options in ({}, {"group": ["bundle"]}, {"ranges": True}):
        assert {r["status"] for r in trees.match(a, none, KEYS, **options).collect()} == {"only_in_org_a"}
        assert {r["status"] for r in trees.match(none, b, KEYS, **options).collect()} == {"only_in_org_b"}
        assert trees.match(none, none, KEYS, **options).count() == 0
