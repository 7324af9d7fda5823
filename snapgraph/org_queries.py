"""Queries of folder scans, lexers and the graph build over a generated org, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.adapters import once, table
from snapgraph.catalog import query
from snapgraph.generated import SQL, files, write_folder
from snapgraph.operators import diff
from snapgraph.plans import org
from snapgraph.sources import tree

# ---- folders


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The org on disk, in the shared folder, which must be a mounted one, as for every scan."""
    folder = f"{scratch.folder(spark).removeprefix('file:').replace('//', '/')}/org-{uuid.uuid4().hex}"
    if ":" in folder:
        raise ValueError("scans read folders that are mounted on every machine")
    write_folder(spark, sf_dir, folder)
    return folder


def _scan(spark: SparkSession, sf_dir: str, timeout: float = tree.TIMEOUT) -> DataFrame:
    return tree.read_tree(spark, once(spark, sf_dir, _folder), timeout=timeout)


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, 2.0).where("error is null")


# on disk are the org's files, and these
_DISK = f"""{SQL},
disk AS (SELECT dir, name, content, octet_length(content::BLOB) AS size FROM tree
  UNION ALL SELECT * FROM (VALUES ('', '.hidden.cls', 'x', 1), ('lwc/rowView1', '.keep', '', 0), ('classes', 'Bad.cls', 'class Bad {{ }} // ' || chr(65533) || chr(10) || 'end' || chr(10), 24),
    ('lwc/rowView2/inner', 'inner.js-meta.xml', '', 0), ('lwc/rowView2/inner', 'Deep.cls', 'class Deep {{ }}', 14), ('', 'notes.txt', 'none', 4)))"""


@query(
    f"""WITH {_DISK}, c AS (SELECT dir, name, content, size, false AS failed FROM disk WHERE lower(name) LIKE '%.cls' UNION ALL SELECT 'classes', x, '', 0, true FROM (VALUES ('Gone.cls'), ('Late.cls')) t(x))
    SELECT dir, name, content, size::BIGINT AS size_bytes, failed, row_number() OVER (PARTITION BY dir ORDER BY name)::INT AS nth FROM c"""
)
def scanned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files of a folder in order, with a damaged one, one that is gone, and one that never answers."""
    found = tree.class_files(_scan(spark, sf_dir, 2.0))
    nth = F.row_number().over(Window.partitionBy("dir").orderBy("seq"))
    return found.select("dir", "name", "content", "size_bytes", F.col("error").isNotNull().alias("failed"), nth.alias("nth"))


@query(f"WITH {_DISK} SELECT CASE dir WHEN '' THEN name ELSE dir || '/' || name END AS rel_path FROM disk WHERE (lower(name) LIKE '%.cls' OR lower(name) LIKE '%.trigger') AND dir NOT LIKE 'lwc/rowView%'")
def scanned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and triggers outside of bundles."""
    found = _readable(spark, sf_dir)
    return tree.class_files(found, (".cls", ".trigger"), tree.bundle_roots(found)).select("rel_path")


@query(f"WITH {SQL} SELECT 'rowview' || r AS bundle_key, 'rowView' || r AS name, 'lwc/rowView' || r AS root_path FROM re UNION ALL SELECT 'rowview0', 'ROWVIEW0', 'lwc/old/ROWVIEW0'")
def scanned_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle folders: neither the scanned folder itself nor what lies inside a bundle."""
    return tree.bundle_roots(_readable(spark, sf_dir)).select("bundle_key", "name", "root_path")


@query(
    f"""WITH {_DISK}, b AS (SELECT CASE WHEN dir LIKE 'lwc/old/%' THEN 'lwc/old/ROWVIEW0' ELSE 'lwc/' || split_part(dir, '/', 2) END AS root, CASE dir WHEN '' THEN name ELSE dir || '/' || name END AS path FROM disk WHERE dir LIKE 'lwc/%')
    SELECT lower(split_part(root, '/', -1)) AS bundle_key, lower(substr(path, len(root) + 2)) AS file_key, substr(path, len(root) + 2) AS file_name FROM b WHERE root NOT LIKE 'lwc/rowView0' """
)
def scanned_bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of bundles by their path inside; of two bundles of a name the first one, in the order of the scan, is kept."""
    found = _readable(spark, sf_dir)
    roots, _ = diff.first_wins(tree.bundle_roots(found), ["org", "bundle_key"])
    return tree.bundle_files(found, roots).select("bundle_key", "file_key", "file_name")


@query(f"WITH {_DISK} SELECT n_name AS folder, false AS valid, 0::BIGINT AS files FROM nation UNION ALL SELECT 'org', true, count(*) + 3 FROM disk")
def folder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that do not exist are refused, and read as no rows."""
    real = once(spark, sf_dir, _folder)

    def row(name: str, folder: str) -> DataFrame:
        try:
            valid = bool(tree.validate(folder))
        except ValueError:
            valid = False
        return tree.read_tree(spark, folder, timeout=2.0).agg(F.count("*").alias("files")).select(F.lit(name).alias("folder"), F.lit(valid).alias("valid"), "files")

    names = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # 25 at every size
    out = row("org", real)
    for name in names:
        out = out.union(row(name, f"{real}/{name}"))
    return out


# ---- lexers


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir).where("ext in ('.cls', '.trigger')")
    return found.select(F.col("seq").alias("file_seq"), F.col("rel_path").alias("file"), "content")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.declare(_sources(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    roots, _ = diff.first_wins(tree.bundle_roots(found).where("root_path not like 'lwc/old/%'"), ["org", "bundle_key"])
    return tree.bundle_files(found, roots).select(F.col("seq").alias("file_seq"), F.concat(F.lit("lwc:"), "bundle_key").alias("self_id"), F.col("rel_path").alias("file"), "file_key", "content")


@query(
    f"""WITH {SQL}, f AS (SELECT seq, content AS c, name FROM tree),
    w AS (SELECT seq, replace(replace(c, '''a,b''', repeat(' ', 5)), '''Nation' || n || '''', repeat(' ', 8 + len(n::VARCHAR))) AS c, 'Supplier' || s || ': new Ghost' || s || '() in a comment' AS said FROM f JOIN su ON seq = 1000 + s),
    j AS (SELECT seq, r, q, c, replace(c, '// import gone from ''c/ghost'';', repeat(' ', 30)) AS k FROM f JOIN re ON seq IN (201 + 10 * r, 203 + 10 * r))
    SELECT seq AS file_seq, repeat(' ', len(split_part(c, chr(10), 1))) || substr(c, len(split_part(c, chr(10), 1)) + 1) AS code, NULL::VARCHAR AS plain FROM w
    UNION ALL SELECT seq, CASE WHEN seq BETWEEN 10 AND 99 THEN replace(c, '''x''', '   ') ELSE c END, NULL FROM f WHERE name ILIKE '%.cls' AND seq < 1000 OR name LIKE '%.trigger'
    UNION ALL SELECT seq, replace(replace(replace(k, '''@salesforce/apex/Nation' || r || '.of''', repeat(' ', 28 + len(r::VARCHAR))), '''c/rowView' || q || '''', repeat(' ', 11 + len(q::VARCHAR))), '''open(1)''', repeat(' ', 9)), k FROM j"""
)
def stripped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source without comments and strings; scripts also without comments alone."""
    found = files(spark, sf_dir).select(F.col("seq").alias("file_seq"), F.col("rel_path").alias("file"), "content")
    return org.stripped(found)


@query(
    f"""WITH {SQL} SELECT 'apex:plan' || i AS node_id, 'Plan' || i AS name, 'apex_interface' AS kind, NULL::VARCHAR AS parent_id, false AS is_test, 3 AS loc, '' AS extends, '' AS implements FROM pl UNION ALL SELECT 'apex:plan0', 'Plan0', 'apex_interface', NULL, false, 3, '', ''
    UNION ALL SELECT 'apex:watch' || r, 'Watch' || r, 'apex_trigger', NULL, false, 1, '', '' FROM re UNION ALL SELECT 'apex:nation' || n, 'Nation' || n, 'apex_class', NULL, false, 7, '', '' FROM na
    UNION ALL SELECT 'apex:supplier' || s, 'Supplier' || s, 'apex_class', NULL, t, 9, 'Nation' || n, 'Plan' || i || ',Batchable' FROM su
    UNION ALL SELECT 'apex:supplier' || s || '.entry', 'Supplier' || s || '.Entry', 'apex_class', 'apex:supplier' || s, t, 1, 'Nation' || n, '' FROM su
    UNION ALL SELECT 'apex:supplier' || s || '.entry.inner', 'Supplier' || s || '.Entry.Inner', 'apex_class', 'apex:supplier' || s || '.entry', t, 1, '', '' FROM su"""
)
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _declared(spark, sf_dir).where("what = 'type'")
    return types.select("node_id", "name", "kind", "parent_id", "is_test", "loc", F.array_join("extends", ",").alias("extends"), F.array_join("implements", ",").alias("implements"))


_METHODS = """md AS (
  SELECT 'apex:nation' || n AS class_id, unnest(['Nation' || n, 'of', 'touch', 'touch', 'run']) AS name, unnest([2, 2, 1, 2, 1]) AS arity, unnest(['Integer', 'String', 'Integer', 'Integer', 'Integer']) AS first_param_type, false AS is_override, false AS is_test, NULL::VARCHAR AS entry, unnest([2, 3, 4, 5, 6]) AS line, 'Nation' || n AS class_name FROM na
  UNION ALL SELECT 'apex:supplier' || s, unnest(['open', 'run', 'tidy', 'start']), unnest([2, 1, 0, 1]), unnest(['Map', 'Integer', NULL, 'BatchableContext']), unnest([false, true, false, false]), t, unnest(['@AuraEnabled', NULL, NULL, NULL]), unnest([4, 5, 6, 7]), 'Supplier' || s FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'go', 0, NULL, false, t, NULL, 8, 'Supplier' || s || '.Entry' FROM su)"""


@query(f"WITH {SQL}, {_METHODS} SELECT class_id AS node_id, name AS method_name, arity::INT AS arity, first_param_type, is_override, is_test, entry AS entry_point_reason, line::INT AS line, 1 AS loc FROM md")
def declared_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = _declared(spark, sf_dir).where("what = 'method'")
    return methods.select("node_id", "method_name", "arity", "first_param_type", "is_override", "is_test", "entry_point_reason", "line", "loc")


_SYMBOLS = """sy AS (SELECT 'plan' || i AS name_lc, 'apex:plan' || i AS id FROM pl UNION ALL SELECT 'nation' || n, 'apex:nation' || n FROM na UNION ALL SELECT 'watch' || r, 'apex:watch' || r FROM re UNION ALL SELECT 'supplier' || s || x, 'apex:supplier' || s || x FROM su, (VALUES (''), ('.entry'), ('.entry.inner')) v(x)
  UNION ALL SELECT 'entry', 'apex:supplier' || min(s) || '.entry' FROM su UNION ALL SELECT 'inner', 'apex:supplier' || min(s) || '.entry.inner' FROM su)"""


@query(f"WITH {SQL}, {_SYMBOLS} SELECT name_lc, id FROM sy")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.symbols(_declared(spark, sf_dir))


# of each supplier, nation and trigger: what it refers to, in the order of its file
_REFERENCES = """rf(self_id, target, kind, line, caller, caller_arity, callee, callee_arity, exact_type, is_test) AS (
  SELECT 'apex:supplier' || s, 'apex:nation' || n, unnest(['extends', 'dynamic_instantiation', 'type_reference', 'static_call', 'instantiation', 'instance_call', 'instance_call', 'instance_call', 'instanceof']), unnest([2, 6, 3, 3, 4, 4, 5, 5, 6]),
    unnest([NULL, 'tidy', NULL, NULL, 'open', 'open', 'run', 'run', 'tidy']), unnest([NULL, 0, NULL, NULL, 2, 2, 1, 1, 0]), unnest([NULL, 'Nation' || n, NULL, 'of', 'Nation' || n, 'touch', 'touch', 'run', NULL]), unnest([NULL, 0, NULL, 2, 2, 1, 2, 1, NULL]),
    unnest([false, false, false, false, false, true, false, false, false]), t FROM su
  UNION ALL SELECT 'apex:supplier' || s, 'apex:plan' || i, 'implements', 2, NULL, NULL, NULL, NULL, false, t FROM su
  UNION ALL SELECT 'apex:supplier' || s, 'apex:supplier' || s, 'self_call', 5, 'run', 1, 'tidy', 0, false, t FROM su, range(2)
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:nation' || n, 'extends', 8, NULL, NULL, NULL, NULL, false, false FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:supplier' || s, 'static_call', 8, 'go', 0, 'tidy', 0, false, false FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:supplier' || s || '.entry.inner', 'type_reference', 8, 'go', 0, NULL, NULL, false, false FROM su
  UNION ALL SELECT 'apex:nation' || n, 'apex:nation' || n, 'type_reference', unnest([2, 3]), NULL, NULL, NULL, NULL, false, false FROM na
  UNION ALL SELECT 'apex:nation' || n, 'apex:plan' || i, unnest(['type_reference', 'instance_call']), 6, 'run', 1, unnest([NULL, 'run']), unnest([NULL, 1]), false, false FROM na
  UNION ALL SELECT 'apex:watch' || r, 'apex:nation' || r, 'static_call', 1, NULL, NULL, 'of', 2, false, false FROM re)"""


@query(f"WITH {SQL}, {_REFERENCES} SELECT self_id, target, kind, line::INT AS line, caller, caller_arity::INT AS caller_arity, callee, callee_arity::INT AS callee_arity, exact_type, is_test FROM rf")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of every class and trigger: variables by scope, nested names, enclosing methods, calls with their arguments."""
    sources, declared = _sources(spark, sf_dir), _declared(spark, sf_dir)
    types, _ = org.first_types(declared)
    methods = org.first_methods(declared, declared.where("what = 'type'"), types)
    found = org.class_references(sources, declared, methods, org.symbols(declared))
    return found.select("self_id", "target", "kind", "line", "caller", "caller_arity", "callee", "callee_arity", "exact_type", "is_test")


_USAGE = "CASE r % 3 WHEN 0 THEN 'apex_wire' WHEN 1 THEN 'apex_imperative' ELSE 'apex_unused_import' END"


@query(
    f"""WITH {SQL} SELECT 'lwc:rowview' || r AS self_id, 'apex:nation' || r AS target, {_USAGE} AS kind, 1 AS line, 'imported as `open`, calls Nation' || r || '.of()' AS detail, CASE WHEN r % 3 < 2 THEN 'of' END AS callee, 'import open from ''@salesforce/apex/Nation' || r || '.of'';' AS snippet FROM re
    UNION ALL SELECT 'lwc:rowview' || r, 'lwc:rowview' || q, 'js_import', 3, 'imported as `child`', NULL, 'import child from ''c/rowView' || q || ''';' FROM re"""
)
def script_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = org.script_references(_parts(spark, sf_dir), org.symbols(_declared(spark, sf_dir)), _components(spark, sf_dir))
    return found.select("self_id", "target", "kind", "line", "detail", "callee", "snippet")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(F.substring("self_id", 5, 1000).alias("name_lc"), F.col("self_id").alias("id")).distinct()


@query(f"WITH {SQL} SELECT 'lwc:rowview' || r AS self_id, 'lwc:rowview' || q AS target, 'composition' AS kind, 2 AS line, '<c-row-view' || q || '>' AS detail, '<c-row-view' || q || '></c-row-view' || q || '> <c-row-view' || q || '/>' AS snippet FROM re")
def template_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.template_references(_parts(spark, sf_dir), _components(spark, sf_dir)).select("self_id", "target", "kind", "line", "detail", "snippet")


@query(f"WITH {SQL} SELECT 'Missing' || s AS name FROM su UNION ALL SELECT unnest(['Batchable', 'ghost'])")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that sources create, extend or import and nothing declares."""
    symbols = org.symbols(_declared(spark, sf_dir))
    return org.unknown_names(_sources(spark, sf_dir), _parts(spark, sf_dir), symbols, _components(spark, sf_dir))


# ---- the whole build


def _org(spark: SparkSession, sf_dir: str) -> org.Graph:
    return org.build(files(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str) -> org.Graph:
    return once(spark, sf_dir, _org)


_NODES = """nd AS (
  SELECT DISTINCT 'apex:plan' || i AS id, 'Plan' || i AS name, 'apex_interface' AS type, false AS is_test, NULL::VARCHAR AS parent_id, 3 AS loc, NULL::VARCHAR AS entry_point_reason FROM pl
  UNION ALL SELECT 'apex:watch' || r, 'Watch' || r, 'apex_trigger', false, NULL, 1, NULL FROM re UNION ALL SELECT 'apex:nation' || n, 'Nation' || n, 'apex_class', false, NULL, 7, NULL FROM na
  UNION ALL SELECT 'apex:supplier' || s, 'Supplier' || s, 'apex_class', t, NULL, 9, NULL FROM su UNION ALL SELECT 'apex:supplier' || s || '.entry', 'Supplier' || s || '.Entry', 'apex_class', t, 'apex:supplier' || s, 1, NULL FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry.inner', 'Supplier' || s || '.Entry.Inner', 'apex_class', t, 'apex:supplier' || s || '.entry', 1, NULL FROM su
  UNION ALL SELECT 'lwc:rowview' || r, CASE r WHEN 0 THEN 'rowView0' ELSE 'rowView' || r END, 'lwc_component', false, NULL, 4, NULL FROM re
  UNION ALL SELECT class_id || '::' || name || '!' || arity, class_name || '.' || name || '(' || CASE arity WHEN 0 THEN '' WHEN 1 THEN '1 arg' ELSE arity || ' args' END || ')', 'apex_method', is_test, class_id, 1, coalesce(entry, CASE name WHEN 'start' THEN 'Batchable.start' END) FROM md)"""


@query(f"WITH {SQL}, {_METHODS}, {_NODES} SELECT id, name, type, is_test, parent_id, loc::INT AS loc, entry_point_reason FROM nd")
def org_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).names.select("id", "name", "type", "is_test", "parent_id", "loc", "entry_point_reason")


# (source, target, dominant kind, occurrences, whether all of them are tests')
_EDGES = f"""ed(source, target, kind, n, t) AS (
  SELECT 'apex:supplier' || s, 'apex:nation' || n, 'instance_call', 9, t FROM su UNION ALL SELECT 'apex:supplier' || s, 'apex:plan' || i, 'implements', 1, t FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:nation' || n, 'extends', 1, false FROM su UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:supplier' || s, 'static_call', 1, false FROM su
  UNION ALL SELECT 'apex:supplier' || s || '.entry', 'apex:supplier' || s || '.entry.inner', 'type_reference', 1, false FROM su
  UNION ALL SELECT 'apex:nation' || n, 'apex:plan' || i, 'type_reference', 2, false FROM na UNION ALL SELECT 'apex:watch' || r, 'apex:nation' || r, 'static_call', 1, false FROM re
  UNION ALL SELECT 'lwc:rowview' || r, 'apex:nation' || r, {_USAGE}, 1, false FROM re UNION ALL SELECT 'lwc:rowview' || r, 'lwc:rowview' || q, 'js_import', 2, false FROM re
  UNION ALL SELECT 'apex:supplier' || s, 'apex:nation' || n || '::of!2', 'static_call', 1, t FROM su
  UNION ALL SELECT 'apex:supplier' || s || '::open!2', 'apex:nation' || n || unnest(['::Nation' || n || '!2', '::touch!1']), unnest(['instantiation', 'instance_call']), 1, t FROM su
  UNION ALL SELECT 'apex:supplier' || s || '::run!1', 'apex:nation' || n || unnest(['::touch!2', '::run!1']), 'instance_call', 1, t FROM su UNION ALL SELECT 'apex:supplier' || s || '::run!1', 'apex:supplier' || s || '::tidy!0', 'self_call', 2, t FROM su
  UNION ALL SELECT 'apex:supplier' || s || '::tidy!0', 'apex:nation' || n || '::Nation' || n || '!2', 'dynamic_instantiation', 1, t FROM su UNION ALL SELECT 'apex:supplier' || s || '.entry::go!0', 'apex:supplier' || s || '::tidy!0', 'static_call', 1, false FROM su
  UNION ALL SELECT 'apex:watch' || r, 'apex:nation' || r || '::of!2', 'static_call', 1, false FROM re UNION ALL SELECT 'lwc:rowview' || r, 'apex:nation' || r || '::of!2', {_USAGE}, 1, false FROM re WHERE r % 3 < 2
  UNION ALL SELECT 'apex:nation' || na.n || x, 'apex:supplier' || s || y, 'possible_implementation', 1, false FROM na JOIN su ON na.i = su.i, (VALUES ('', ''), ('::run!1', '::run!1')) v(x, y)
  UNION ALL SELECT 'apex:supplier' || a.s || x, 'apex:supplier' || b.s || x, 'possible_override', 1, a.t FROM su a JOIN su b ON a.n = b.n, (VALUES (''), ('::run!1')) v(x))"""


@query(f"WITH {SQL}, {_EDGES} SELECT source, target, kind, n::BIGINT AS n_occ, CASE WHEN t THEN 0 ELSE n END::BIGINT AS n_prod FROM ed")
def org_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and method edges, with what subtypes may run instead."""
    return _graph(spark, sf_dir).counted.select("source", "target", "kind", "n_occ", "n_prod")


@query(
    f"""WITH {SQL}, {_METHODS}, {_NODES}, {_EDGES} SELECT count(*) FILTER (type <> 'apex_method') AS total_nodes, count(*) FILTER (type = 'apex_class') AS apex_classes, count(*) FILTER (type = 'apex_interface') AS apex_interfaces,
    count(*) FILTER (type = 'apex_trigger') AS apex_triggers, count(*) FILTER (type = 'lwc_component') AS lwc_components, count(*) FILTER (type = 'apex_method') AS apex_methods, count(*) FILTER (type <> 'apex_method' AND is_test) AS test_classes,
    (SELECT count(*) FROM ed) AS total_edges, (SELECT count(*) + 2 FROM su) AS unresolved_reference_count, 2::BIGINT AS duplicate_count, 'Plan0,rowview0' AS duplicate_names FROM nd"""
)
def org_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).summary().withColumn("duplicate_names", F.array_join("duplicate_names", ","))

