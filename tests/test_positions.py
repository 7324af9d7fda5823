"""Places in an order, sums before them, and pages."""

import random

from pyspark.sql import functions as F

from snapgraph.operators import positions


def test_places_and_sums(spark):
    random.seed(1)
    rows = [(random.randrange(400), random.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, w int").repartition(9)
    got = sorted(positions.number(df, [F.col("k").desc(), F.col("w")], weight=F.col("w")).collect(), key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.w) for r in got] == want and [r.place for r in got] == list(range(3000))
    assert [r.before for r in got] == [sum(w for _, w in want[:i]) for i in range(3000)]
    assert positions.number(df.limit(0), [F.col("k")]).count() == 0


def test_pages(spark):
    indexed = positions.index(spark.range(10_000).select((F.lit(9_999) - F.col("id")).alias("k")), [F.col("k")])
    assert [(r.k, r.place) for r in positions.page(indexed, 4_990, 20).collect()] == [(k, k) for k in range(4_990, 5_010)]
    assert positions.page(indexed, 20_000, 5).count() == 0
    plan = positions.page(indexed, 4_990, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(place), GreaterThanOrEqual(place,4990), LessThanOrEqual(place,5009)]" in plan
