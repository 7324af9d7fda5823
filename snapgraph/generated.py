"""An org's source files from ordinary tables, one class a supplier, so that scans, lexers and the graph build run on Parquet data.

Suppliers are classes below their nation's class, with fields, constructors'
calls, overloads, overrides, comments, strings and nested types; nations are base
classes, plans interfaces, regions triggers and web components. A type and a
bundle stand twice. Every seventh supplier is a test class.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.adapters import table
from snapgraph.schemas import FILES

PLANS = 4

SUPPLIER = """// Supplier {s}: new Ghost{s}() in a comment
{test}public virtual class Supplier{s} extends Nation{n} implements Plan{i}, Database.Batchable<SObject> {{
    Nation{n} home = Nation{n}.of('a,b', 1);
    @AuraEnabled public static void open(final Map<String, Id> a, List<Id> b) {{ new Nation{n}(1, f(2, 3)).touch(1); }}
    public override void run(Integer k) {{ home.touch(k, 2); home.run(2); this.tidy(); tidy(); }}
    void tidy() {{ Object o; if (o instanceof Nation{n}) {{ Type.forName('Nation{n}'); }} Missing{s} x = new Missing{s}(); }}
    public Iterable<SObject> start(Database.BatchableContext c) {{ return null; }}
    class Entry extends Nation{n} {{ void go() {{ tidy(); Inner z; }} class Inner {{ }} }}
}}"""
NATION = """public virtual class Nation{n} {{
    public Nation{n}(Integer a, Integer b) {{ }}
    public static Nation{n} of(String a, Integer b) {{ return null; }}
    public virtual void touch(Integer a) {{ }}
    public void touch(Integer a, Integer b) {{ }}
    public virtual void run(Integer k) {{ Plan{i} p = null; p.run(k); }}
}}"""
PLAN = "public interface Plan{i} {{\n    void run(Integer k);\n}}"
TRIGGER = "trigger Watch{r} on Account (before insert) {{ Nation{r}.of('x', 2); }}"
SCRIPT = """import open from '@salesforce/apex/Nation{r}.of';
// import gone from 'c/ghost';
import child from 'c/rowView{q}';
{used}
"""
PAGE = """<template>
<c-row-view{q}></c-row-view{q}> <c-row-view{q}/>
<!-- <c-ghost> -->
<c-row-view{r}></c-row-view{r}>
</template>
"""
USES = ("@wire(open, {}) data;", "open({a: 1});", "const s = 'open(1)';")


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("{{", "\0").replace("}}", "\1").split("{")):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        parts += [values[name].cast("string")] if name else []
        parts.append(F.lit(rest.replace("\0", "{").replace("\1", "}")))
    return F.concat(*parts)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The org as the relation that `sources.tree` reads from a folder."""
    suppliers, nations, regions = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    s, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    q = (r + 1) % 5
    used = F.element_at(F.array(*[F.lit(u) for u in USES]), (r % 3 + 1).cast("int"))
    plans = spark.range(PLANS).withColumnRenamed("id", "i")
    i = F.col("i")
    bundle = fill("lwc/rowView{r}", r=r)

    def part(df: DataFrame, seq: Column, folder: Column, name: Column, content: Column) -> DataFrame:
        return df.select(seq.cast("long").alias("seq"), folder.alias("dir"), name.alias("name"), content.alias("content"))

    classes = F.lit("classes")
    parts = [
        part(plans, i, classes, fill("Plan{i}.cls", i=i), fill(PLAN, i=i)),
        part(regions, 10 + r, F.lit("triggers"), fill("Watch{r}.trigger", r=r), fill(TRIGGER, r=r)),
        part(nations, 100 + n, classes, fill("Nation{n}.cls", n=n), fill(NATION, n=n, i=n % PLANS)),
        part(regions, 200 + 10 * r, bundle, fill("rowView{r}.js-meta.xml", r=r), F.lit("")),
        part(regions, 201 + 10 * r, bundle, fill("rowView{r}.js", r=r), fill(SCRIPT, r=r, q=q, used=used)),
        part(regions, 202 + 10 * r, bundle, fill("rowView{r}.html", r=r), fill(PAGE, r=r, q=q)),
        part(regions, 203 + 10 * r, F.concat(bundle, F.lit("/__tests__")), fill("rowView{r}.test.js", r=r), fill(SCRIPT, r=r, q=q, used=F.lit(USES[1]))),
        part(regions.where(r == 0), F.lit(900), F.lit("classes/again"), F.lit("PLAN0.CLS"), F.lit(PLAN.format(i=0))),
        part(regions.where(r == 0), F.lit(901), F.lit("lwc/old/ROWVIEW0"), F.lit("rowView0.js-meta.xml"), F.lit("")),
        part(suppliers, 1000 + s, classes, fill("Supplier{s}.cls", s=s), fill(SUPPLIER, s=s, n=F.col("s_nationkey"), i=s % PLANS, test=F.when(s % 7 == 3, "@isTest ").otherwise(""))),
    ]
    every = reduce(DataFrame.union, parts)
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    columns = {"org": F.lit("a"), "root": F.lit("/org"), "rel_path": F.concat_ws("/", "dir", "name"), "ext": extension, "size_bytes": F.octet_length("content").cast("long"), "error": F.lit(None).cast("string")}
    return every.withColumns(columns).select(*[c.split()[0] for c in FILES.split(", ")])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (rel_path, content) as files below a folder of the shared ones, by tasks; writing again gives the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = Path(folder, rel)
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select("rel_path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_folder(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The org's files, and some that scans meet: hidden, empty, damaged and unreadable ones."""
    write_files(files(spark, sf_dir), folder)
    extra = {".hidden.cls": b"x", "lwc/rowView1/.keep": b"", "classes/Bad.cls": b"class Bad { } // \xff\r\nend\r", f"{Path(folder).name}.js-meta.xml": b"", "lwc/rowView2/inner/inner.js-meta.xml": b"", "lwc/rowView2/inner/Deep.cls": b"class Deep { }", "notes.txt": b"none"}
    for name, data in extra.items():
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink("nowhere", Path(folder, "classes", "Gone.cls"))
    os.mkfifo(Path(folder, "classes", "Late.cls"))


def _sql(template: str) -> str:
    """The template as a SQL expression over columns of its names."""
    out: list[str] = []
    for i, piece in enumerate(template.replace("{{", "\0").replace("}}", "\1").split("{")):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        out += [f"({name})"] if name else []
        out.append("'" + rest.replace("\0", "{").replace("\1", "}").replace("'", "''") + "'")
    return " || ".join(out)


_CASES = " ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(x.replace("'", "''") for x in USES))
_TEST_SCRIPT = SCRIPT.replace("{used}", USES[1].replace("{", "{{").replace("}", "}}"))

#: su, na, re, pl: the tables by short names; tree: the files (seq, dir, name, content).
SQL = f"""
su AS (SELECT s_suppkey AS s, s_nationkey AS n, s_suppkey % {PLANS} AS i, s_suppkey % 7 = 3 AS t, CASE WHEN s_suppkey % 7 = 3 THEN '@isTest ' ELSE '' END AS test FROM supplier),
na AS (SELECT n_nationkey AS n, n_nationkey % {PLANS} AS i FROM nation),
re AS (SELECT r_regionkey AS r, (r_regionkey + 1) % 5 AS q, CASE r_regionkey % 3 {_CASES} END AS used FROM region),
pl AS (SELECT unnest(range({PLANS})) AS i),
tree AS (
  SELECT i AS seq, 'classes' AS dir, 'Plan' || i || '.cls' AS name, {_sql(PLAN)} AS content FROM pl
  UNION ALL SELECT 10 + r, 'triggers', 'Watch' || r || '.trigger', {_sql(TRIGGER)} FROM re
  UNION ALL SELECT 100 + n, 'classes', 'Nation' || n || '.cls', {_sql(NATION)} FROM na
  UNION ALL SELECT 200 + 10 * r, 'lwc/rowView' || r, 'rowView' || r || '.js-meta.xml', '' FROM re
  UNION ALL SELECT 201 + 10 * r, 'lwc/rowView' || r, 'rowView' || r || '.js', {_sql(SCRIPT)} FROM re
  UNION ALL SELECT 202 + 10 * r, 'lwc/rowView' || r, 'rowView' || r || '.html', {_sql(PAGE)} FROM re
  UNION ALL SELECT 203 + 10 * r, 'lwc/rowView' || r || '/__tests__', 'rowView' || r || '.test.js', {_sql(_TEST_SCRIPT)} FROM re
  UNION ALL SELECT 900, 'classes/again', 'PLAN0.CLS', '{PLAN.format(i=0)}'
  UNION ALL SELECT 901, 'lwc/old/ROWVIEW0', 'rowView0.js-meta.xml', ''
  UNION ALL SELECT 1000 + s, 'classes', 'Supplier' || s || '.cls', {_sql(SUPPLIER)} FROM su)
"""
