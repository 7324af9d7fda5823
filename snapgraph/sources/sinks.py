"""Outputs: JSON rows, deploy lists, package manifests, self-contained HTML reports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgraph import scratch
from snapgraph.functions.difflines import opcodes
from snapgraph.schemas import IDENTICAL, MODIFIED, ONLY_A, ONLY_B
from snapgraph.sources import ordered


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


# The format of a package manifest.
PACKAGE_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>', '<Package xmlns="http://soap.sforce.com/2006/04/metadata">', "    <types>")
PACKAGE_TAIL = ("    </types>", "    <version>59.0</version>", "</Package>")


def _sections(spark: SparkSession, head: Sequence[str], lines: DataFrame, tail: Sequence[str]) -> DataFrame:
    """(section, place, line) in order: fixed lines before and behind the sorted lines (place, line) of a relation."""

    def fixed(section: int, rows: Sequence[str]) -> DataFrame:
        return spark.createDataFrame([(section, f"{i:09d}", x) for i, x in enumerate(rows)], "section int, place string, line string")

    whole = fixed(0, head).union(lines.select(F.lit(1), "place", "line")).union(fixed(2, tail))
    return whole.orderBy("section", F.collate("place", "UNICODE_CI"), "place")


def manifest(names: DataFrame, kind: str = "ApexClass") -> DataFrame:
    """(section, place, line): the lines of a deployable package.xml for class files (name), in order; `text_of` is the file."""
    bare = F.regexp_replace("name", r"(?i)\.cls$", "")
    plain = F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    members = names.select("name").distinct().select(F.col("name").alias("place"), F.concat(F.lit("        <members>"), plain, F.lit("</members>")).alias("line"))
    return _sections(names.sparkSession, PACKAGE_HEAD, members, (f"        <name>{kind}</name>", *PACKAGE_TAIL))


def deploy_list(names: DataFrame) -> DataFrame:
    """(section, place, line): the sorted names, a line each."""
    return _sections(names.sparkSession, (), names.select("name").distinct().select(F.col("name").alias("place"), F.col("name").alias("line")), ())


def text_of(lines: DataFrame) -> str:
    """The file of sorted lines, each ended by a line break; for lists that a person deploys, read in turn by the driver."""
    return "".join(r["line"] + "\n" for r in lines.select("line").toLocalIterator())


def write_manifest(names: DataFrame, path: str, kind: str = "ApexClass") -> int:
    """The deployable package.xml of class files (name) as one file that tasks write; returns its size in bytes."""
    return ordered.write_file(manifest(names, kind), path)


def write_deploy_list(names: DataFrame, path: str) -> int:
    """The sorted names as one file, a line each."""
    return ordered.write_file(deploy_list(names), path)


def export_lines(title: str, compared: DataFrame) -> DataFrame:
    """(section, place, line): a comparison as one self-contained page.

    compared: key, name, status, presence, line counts, content_a and content_b.
    The head says how many items have which status, then comes a row of the
    listing for every item, then a row of details with both contents. Rows are
    JSON in scripts of class classes and details.
    """
    counts = compared.groupBy("status").agg(F.count("*").alias("n")).collect()  # four rows at most
    summary = {"total": sum(r["n"] for r in counts)} | {s: 0 for s in (MODIFIED, IDENTICAL, ONLY_A, ONLY_B)} | {r["status"]: r["n"] for r in counts}
    shown = [c for c in ("key", "name", "status", "in_org_a", "in_org_b", "is_identical", "has_error", "lines_added", "lines_removed", "lines_changed") if c in compared.columns]
    return page_lines(f"{title} ({summary['total']} items)", {"summary": summary}, {"classes": compared.select(*shown), "details": compared.select("key", "name", "status", "content_a", "content_b")})


def write_export(title: str, compared: DataFrame, path: str) -> int:
    """The page of `export_lines` as one file that tasks write; returns its size in bytes."""
    return ordered.write_file(export_lines(title, compared), path)


def write_debug(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def side_by_side(a: str | None, b: str | None) -> list[tuple[str, str | None, str | None]]:
    """(tag, line of a, line of b) of two texts, without terminators."""
    x, y = (a or "").splitlines(), (b or "").splitlines()
    out: list[tuple[str, str | None, str | None]] = []
    for tag, i1, i2, j1, j2 in opcodes(a, b, False):
        for k in range(max(i2 - i1, j2 - j1)):
            out.append((tag, x[i1 + k] if i1 + k < i2 else None, y[j1 + k] if j1 + k < j2 else None))
    return out


def item_report(row: dict) -> str:
    """One compared item as HTML; row: name, status, content_a, content_b."""
    body = []
    for tag, x, y in side_by_side(row["content_a"], row["content_b"]):
        cells = "".join(f"<td>{'' if v is None else html.escape(v)}</td>" for v in (x, y))
        body.append(f'<tr class="{tag}">{cells}</tr>')
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(row['name'])}</title><h1>{html.escape(row['name'])}</h1><p>{html.escape(row['status'])}</p><table>{''.join(body)}</table>"


def page(title: str, data: object) -> str:
    """A self-contained page with its data as JSON; a closing tag inside the data can't end the script."""
    text = json.dumps(data, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
    return f'<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><script id="data" type="application/json">{text}</script>'


def page_lines(title: str, head: object, relations: dict[str, DataFrame]) -> DataFrame:
    """(section, place, line): a self-contained page, small data as JSON in its head and one line of JSON for each row of the relations."""
    out = None
    for name, df in relations.items():
        rows = json_rows(df).select(F.concat(F.lit(f"{name} "), "json").alias("place"), F.lit(None).cast("string").alias("line"))
        out = rows if out is None else out.union(rows)
    lines = _sections(out.sparkSession, (page(title, head),), out, ("</html>",))
    # rows are sorted by their JSON alone, and lines made of it behind the sort
    name, data = F.substring_index("place", " ", 1), F.expr("substring(place, instr(place, ' ') + 1)")
    row = F.concat(F.lit('<script type="application/json" class="'), name, F.lit('">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    return lines.select("section", "place", F.when(F.col("section") == 1, row).otherwise(F.col("line")).alias("line"))


def blast_page(nodes: DataFrame, edges: DataFrame, focus: dict, depth: int | None, direction: str) -> DataFrame:
    """The page of a node's surroundings (see `views.blast_radius`): focus, depth, direction and summary in its head, nodes and edges as rows."""
    nodes, edges = scratch.keep(nodes, "page"), scratch.keep(edges, "page")  # counted, sampled for the sort, and sorted
    counts = {"total_nodes": nodes.count(), "total_edges": edges.count(), "unresolved_reference_count": 0}
    head = {"summary": counts, "focus": focus["id"], "depth": "all" if depth is None else depth, "direction": direction}
    return page_lines(f"Blast Radius — {focus['name']}", head, {"nodes": nodes, "edges": edges})


@F.pandas_udf(T.StringType())
def _item_reports(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([item_report(r) for r in rows.to_dict("records")])


def item_reports(compared: DataFrame) -> DataFrame:
    """compared with html, each item's own report."""
    return compared.withColumn("html", _item_reports(F.struct("name", "status", "content_a", "content_b")))
