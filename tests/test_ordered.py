"""Ordered files: their bytes, lost and repeated attempts, failures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from snapgraph.sources import ordered, sinks


def lines_of(spark, n):
    return spark.range(n).select(F.lit(1).alias("section"), F.lpad(F.col("id").cast("string"), 9, "0").alias("place"), F.concat(F.lit("zeile é "), F.col("id").cast("string")).alias("line"))


def test_the_file_holds_the_lines_in_order(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    lines = lines_of(spark, 5000).repartition(6).orderBy("section", "place")
    want = "".join(f"zeile é {i}\n" for i in range(5000)).encode()
    assert ordered.write_file(lines, path) == len(want)
    assert open(path, "rb").read() == want
    assert os.listdir(tmp_path) == ["out.txt"]
    ordered.write_file(lines.limit(0), path)  # an older file is replaced
    assert open(path, "rb").read() == b"" and ordered.read_file(spark, path).count() == 0


def test_lines_are_read_with_their_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 1000)
    path = str(tmp_path / "in.txt")
    texts = ["", "a", "x" * 2500, "é" * 700, "", "last"]
    with open(path, "wb") as f:
        f.write("\n".join(texts).encode())
    got = sorted((r["at"], r["line"]) for r in ordered.read_file(spark, path).collect())
    at = [len("\n".join(texts[:i]).encode()) + bool(i) for i in range(len(texts))]
    assert got == list(zip(at, texts, strict=True))


def test_only_attempts_in_the_manifest_count(spark, tmp_path):
    folder = str(tmp_path / "parts")
    manifest = ordered.write_parts(lines_of(spark, 300).repartition(3).orderBy("place"), folder)
    assert manifest["size"] == sum(p["size"] for p in manifest["parts"]) and [p["at"] for p in manifest["parts"]] == sorted(p["at"] for p in manifest["parts"])
    with open(f"{folder}/part-00000000-999999", "wb") as f:  # what a lost attempt left
        f.write(b"half a li")
    path = str(tmp_path / "out.txt")
    for _ in range(2):  # copying again gives the same
        ordered.assemble(spark, folder, json.load(open(f"{folder}/{ordered.MANIFEST}")), path)
        assert open(path).read() == "".join(f"zeile é {i}\n" for i in range(300))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = lines_of(spark, 100).withColumn("line", F.when(F.col("place") == "000000050", F.raise_error(F.lit("no such line"))).otherwise(F.col("line")))
    path = tmp_path / "out.txt"
    path.write_text("older\n")
    with pytest.raises(Exception, match="no such line"):
        ordered.write_file(bad.repartition(4).orderBy("place"), str(path))
    assert os.listdir(tmp_path) == ["out.txt"] and path.read_text() == "older\n"
    with pytest.raises(OSError):
        ordered.assemble(spark, str(tmp_path), {"size": 3, "parts": []} | {"parts": [{"name": "out.txt", "at": 0, "size": 3}]}, str(tmp_path / "x"))
    assert os.listdir(tmp_path) == ["out.txt"]


def test_manifest_and_export_files(spark, tmp_path):
    names = spark.createDataFrame([("b.Cls",), ("A&1.cls",), ("b.Cls",), ("c.trigger",)], "name string")
    path = str(tmp_path / "package.xml")
    size = sinks.write_manifest(names, path)
    text = open(path).read()
    assert size == len(text.encode()) and text.split("\n")[3:6] == ["        <members>A&amp;1</members>", "        <members>b</members>", "        <members>c.trigger</members>"]
    assert text == sinks.text_of(sinks.manifest(names))
    compared = spark.createDataFrame([("k1", "K1", "modified", "a</script>", "b"), ("k2", "K2", "only_in_org_a", "x\ny", None)], "key string, name string, status string, content_a string, content_b string")
    path = str(tmp_path / "export.html")
    sinks.write_export("T", compared, path)
    rows = open(path).read().split("\n")
    assert "(2 items)" in rows[0] and '"total": 2' in rows[0] and rows[-2:] == ["</html>", ""]
    data = [json.loads(r.split(">", 1)[1].rsplit("</script>", 1)[0]) for r in rows[1:-2]]
    assert [d["key"] for d in data] == ["k1", "k2", "k1", "k2"] and data[2]["content_a"] == "a</script>" and "</script" not in rows[3].split(">", 1)[1].rsplit("</script>", 1)[0]


def test_pages_sort_their_rows_once(spark):
    """A page's rows go through the sort as JSON alone; a closing tag in them can't end the script."""
    from snapgraph.sources import sinks

    lines = sinks.page_lines("t", {}, {"rows": spark.createDataFrame([("b </script> c",), ("a",)], "x string")})
    assert [r.line for r in lines.where("section = 1").collect()] == ['<script type="application/json" class="rows">{"x":"a"}</script>', '<script type="application/json" class="rows">{"x":"b <\\/script> c"}</script>']
    exchange = next(x for x in lines._jdf.queryExecution().optimizedPlan().toString().split("Sort ")[1:])
    assert "<script type" not in exchange
