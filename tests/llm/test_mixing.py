from pyspark.sql import functions as F

from snapgraph.llm import mixing


def share(sizes, weights, most=3.0):
    """Targets by resharing until none is above its cap."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = float(sum(sizes.values())), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_by_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1, "b": 1}, {"b": 0, "a": 7, "é": 900, "z": 20, "A": 3}, {None: 4}, {"a": 0}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = share(sizes, (5, 2, 1))
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes), (sizes, got, want)


def test_report_and_mix_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    report = mixing.mix_report(docs)
    by = report.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert abs(sum(r.target for r in by) / sum(r.source_size for r in by) - 1) < 1e-9 or all(r.target == 3 * r.source_size for r in by)
    assert report.where("taken > 3 * size").count() == 0
    assert mixing.mix_report(docs).exceptAll(report).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == report.agg(F.sum("copies")).first()[0]


def test_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b\x1fc", None), (3, "a b\x1fc", None), (None, "x\ty\x0bz", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_size": F.lit(1), "_copies": F.lit("x"), "size": F.lit(0), "_row": F.lit(2)})
    got = mixing.mix_report(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert len({(r.target, r.copies) for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix_report(df.where("doc_id = 1")).first().taken == 0


def test_taken_words_come_near_targets(spark):
    """Texts of 20 words at most, so a source's taken words lie within a few standard deviations of its target."""
    rows = [(i, " ".join(["w"] * (i % 20 + 1)), "abc"[(i % 100 > 60) + (i % 100 > 90)]) for i in range(30_000)]
    report = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = report.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum(F.col("size") ** 2).alias("squares")).collect()
    assert len(by) == 3
    for r in by:
        assert abs(r.taken - r.target) <= 4 * (0.25 * r.squares) ** 0.5


def test_very_long_text_and_ties(spark):
    rows = [(1, "w " * 1_000_000, "a"), (2, "w " * 1_000_000, "b"), (2, "w " * 1_000_000, "b")]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.size for r in got} == {1_000_000} and len({(r.source_size, r.target, r.copies) for r in got if r.doc_id == 2}) == 1
