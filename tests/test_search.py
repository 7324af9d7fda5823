"""Rows by a part of their name, and stored relations by key."""

import random

from pyspark.sql import functions as F

from snapgraph.operators import search, stored


def found(index, spark, wanted):
    return sorted((r.wanted, r.id) for r in search.find(index, spark.createDataFrame([(w,) for w in wanted], "wanted string")).collect())


def test_parts_of_names(spark, monkeypatch):
    random.seed(2)
    names = ["".join(random.choices("abAB.é ", k=random.randrange(0, 9))) for _ in range(300)] + ["aaaa", "supplier 12", "SUPPLIER 2", None]
    index = search.build(spark.createDataFrame(list(enumerate(names)), "id int, name string"))
    wanted = ["a", "ab", "AbA", "abab", "aa", "aaaa", "é a", "lier", " Supplier 1 ", "nothing", "", "  ", ".", "b.b"] + [n[1:6] for n in names[:40] if n]
    want = sorted({(w, i) for w in wanted for i, n in enumerate(names) if n is not None and w.strip(" ") and w.strip(" ").lower() in n.lower()})
    assert found(index, spark, wanted) == want
    monkeypatch.setattr(search, "LISTED", 2)
    assert found(index, spark, wanted) == want
    assert found(index, spark, []) == []


def test_a_part_reads_its_rarest_trigram_alone(spark):
    index = search.build(spark.range(20_000).select("id", F.concat(F.lit("common name "), F.col("id").cast("string")).alias("name")))
    wanted = spark.createDataFrame([("name 12345",)], "wanted string")
    df = search.find(index, wanted)
    assert [r.id for r in df.collect()] == [12345]
    assert "PushedFilters: [In(gram, [" in df._jdf.queryExecution().executedPlan().toString() or "EqualTo(gram," in df._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_by_key(spark, monkeypatch):
    rows = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    table = stored.store(rows, "key")
    wanted = spark.createDataFrame([("k7", 1), ("k49999", 2), ("k7", 3), ("none", 4), (None, 5)], "key string, n int")
    want = [("k49999", 2, 49_999), ("k7", 1, 7), ("k7", 3, 7)]
    for most in (1000, 1):
        monkeypatch.setattr(stored, "LISTED", most)
        assert sorted(tuple(r) for r in stored.look_up(table, wanted, "key").collect()) == want
    assert stored.look_up(table, wanted.limit(0), "key").count() == 0
