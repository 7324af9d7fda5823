from pyspark.sql import functions as F

import corpus_pipeline
from snapgraph.llm import bpe, lines, mixing, neardup, quality


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mix", "bpe"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r.doc_id for r in quality.sample(docs, labels).collect()}
    current, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, sf_dir).cache()
        seen[name] = current
        if name != "bpe":
            assert current.columns == docs.columns
    assert {r.doc_id for r in seen["quality"].collect()} == want
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(seen["quality"], "doc_id", "left_anti").count() <= 0.02 * good.count() + 1
    assert seen["lines"].count() == seen["quality"].count()
    assert {r.doc_id: r.text for r in seen["lines"].collect()} == {r.doc_id: r.text for r in lines.report(seen["quality"]).collect()}
    assert seen["lines"].where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {r.doc_id for r in neardup.report(seen["lines"]).where("representative").collect()}
    assert seen["mix"].count() == mixing.mix_report(seen["near_duplicates"]).agg(F.sum("copies")).first()[0]
    import public_tokenizers as P

    back = bpe.decode(seen["bpe"], P.path("byte_bpe_50k.tiktoken"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in seen["mix"].collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, seen["bpe"].select("doc_id", "ids_sha256").collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, names that operators use themselves, and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, node string, _row int, span string"
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "one line here\nand another", "en", "a", 25, "n", 1, "s"), (1, "one line here\nand another", "en", "a", 25, "n", 1, "s"), (None, "text of no id", None, None, None, None, None, None)]
    rows += [(2, None, "en", "a", None, None, 2, None), (3, "", "en", "b", 0, None, 3, None), (4, long, "en", "b", len(long), "n", 4, "x"), (5, long + " end", "en", None, len(long) + 4, "n", 5, "x")]
    docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == "bpe":
            assert len(got) == len(rows)
            continue
        assert out.columns == docs.columns
        if name == "lines":
            assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 1} == {"one line here\nand another"}
        if name == "near_duplicates":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
