"""A folder of sources end to end: scan, lexing, resolution, graph, queries."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from snapgraph.operators import diff
from snapgraph.plans import org, views
from snapgraph.sources import tree

FILES = {
    "classes/Ledger.cls": """public virtual class Ledger implements Posting, Database.Batchable<SObject> {
    private Rate rate = Rate.standard();
    public Ledger() { init(); }
    void init() { Rate r = new Rate(2, 'a,b'); r.apply(1); this.tidy(); }
    public void tidy() { /* Audit.unused('x'); */ String s = 'Audit.unused()'; }
    public virtual void post(Integer n) { Audit.log(n); }
    public Iterable<SObject> start(Database.BatchableContext c) { return null; }
    @AuraEnabled public static void open(Id x) { new Ledger().post(3); Type.forName('Audit').newInstance(); }
    class Entry { void go() { init(); Inner z; } class Inner { } }
    void loopA() { loopB(); }
    void loopB() { loopA(); }
}""",
    "classes/SubLedger.cls": "public class SubLedger extends Ledger { public override void post(Integer n) { super.post(n); } }",
    "classes/Posting.cls": "public interface Posting { void post(Integer n); }",
    "classes/Rate.cls": "public class Rate { public Rate(Integer a, String b) {} public static Rate standard() { return null; } public void apply(Integer k) {} public void apply(Integer k, Integer j) {} }",
    "classes/Audit.cls": "public class Audit { public static void log(Object o) { Posting p = null; p.post(1); Missing m = new Missing(); } public static void unused() { } }",
    "classes/deep/audit.cls": "public class Audit { public static void extra() { } }",
    "classes/LedgerTest.cls": "@isTest\nprivate class LedgerTest { @isTest static void t() { Ledger l = new Ledger(); l.loopA(); l.post(1); } }",
    "classes/Plan.cls": "public interface Plan extends Queueable { }",
    "classes/Job.cls": "public class Job implements Plan { public void execute(QueueableContext c) { } public void execute(String s) { } }",
    "classes/Alone.cls": "public class Alone { }",
    "classes/Kinds.cls": "public enum Kinds { A, B }",
    "classes/One.cls": "public class One { public void a() { Two.b(1); } public void x() { } }",
    "classes/Two.cls": "public class Two { public static void b(Integer i) { } public static void c() { Three.d(); } }",
    "classes/Three.cls": "public class Three { public static void d() { } }",
    "triggers/Watch.trigger": "trigger Watch on Account (before insert) { Audit.log(1); }",
    "lwc/cardView/cardView.js-meta.xml": "",
    "lwc/cardView/cardView.js": "import open from '@salesforce/apex/Ledger.open';\nimport x from 'c/childRow'; import y from 'c/nowhere';\nopen({a:1});\n",
    "lwc/cardView/cardView.html": "<template><c-child-row></c-child-row><!-- <c-child-row> --></template>",
    "lwc/cardView/__tests__/cardView.test.js": "import z from '@salesforce/apex/Rate.standard';",
    "lwc/cardView/inner/inner.js-meta.xml": "",
    "lwc/childRow/childRow.js-meta.xml": "",
    "lwc/childRow/childRow.js": "export default 1;",
    "lwc/childRow/.hidden": "x",
    "lwc/other/childrow/childRow.js-meta.xml": "",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("org")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "classes/Bad.cls").write_bytes(b"public class Bad { } // \xff\r\n")
    return str(root)


@pytest.fixture(scope="module")
def built(spark, folder):
    return org.build(tree.read_tree(spark, folder))


@pytest.fixture(scope="module")
def nodes(built):
    return {r.id: r for r in built.nodes.collect()}


@pytest.fixture(scope="module")
def edges(built):
    return {(r.source, r.target): r for r in built.edges.collect()}


def walk(folder):
    """Folder and name of every file, top-down, names in order."""
    for at, folders, names in os.walk(folder):
        folders.sort()
        yield from ((at, f) for f in sorted(names))


def test_tree_reads_hidden_and_empty_files(spark, folder):
    # T10, T2, T3
    rows = {r.rel_path: r for r in tree.read_tree(spark, folder).collect()}
    assert len(rows) == len(FILES) + 1
    assert rows["lwc/childRow/.hidden"].content == "x" and rows["lwc/cardView/cardView.js-meta.xml"].size_bytes == 0
    bad = rows["classes/Bad.cls"]
    assert bad.content == "public class Bad { } // �\n" and bad.size_bytes == 27
    assert [r.rel_path for r in sorted(rows.values(), key=lambda r: r.seq)] == [os.path.relpath(os.path.join(at, f), folder) for at, f in walk(folder)]


def test_files_are_listed_as_a_walk_meets_them(spark, tmp_path, monkeypatch):
    """Names that begin like others, deep folders, links, empty folders; several tasks read."""
    monkeypatch.setattr(tree, "PACK", 1 << 20)
    random.seed(11)
    names = ["a", "a b", "a!", "aa", "A", "é", "z", "a.b", ".a", "\U0001f600", "\uffee"]
    for _ in range(120):
        at = tmp_path.joinpath(*random.choices(names, k=random.randrange(4)))
        at.mkdir(parents=True, exist_ok=True)
        file = at / f"f{random.choice(names)}{random.randrange(3)}.txt"
        file.write_text(file.name)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "empty", tmp_path / "to folder")
    os.symlink(next(tmp_path.rglob("*.txt")), tmp_path / "to file")
    got = sorted(tree.read_tree(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    want = list(walk(tmp_path))
    assert [(r.dir, r.name) for r in got] == [("" if str(at) == str(tmp_path) else os.path.relpath(at, tmp_path), f) for at, f in want]
    assert [r.seq for r in got] == list(range(len(want)))
    assert all(r.error is None and (r.content == r.name or r.name == "to file") for r in got)
    assert {r.name for r in tree.read_tree(spark, str(tmp_path), suffixes=(".TXT",)).collect()} == {r.name for r in got} - {"to file"}


def test_late_files_leave_no_threads(spark, tmp_path):
    os.mkfifo(tmp_path / "late")
    (tmp_path / "soon").write_text("x")
    before = threading.active_count()
    assert [e for _, _, e in tree.read_batch([str(tmp_path / "late"), str(tmp_path / "soon")], 0.5)] == ["not read within 0.5 s", None]
    for t in threading.enumerate():
        if t.daemon and t is not threading.main_thread() and "read" in t.name:
            t.join(5)
    assert threading.active_count() <= before
    os.mkfifo(tmp_path / "slow")

    def write():
        with open(tmp_path / "slow", "w") as f:
            f.write("answer")

    threading.Thread(target=write).start()
    assert tree.read_batch([str(tmp_path / "slow")], 5)[0] == ("answer", 6, None)


def test_missing_folder_is_empty(spark, folder):
    assert tree.read_tree(spark, folder + "/none").count() == 0
    with pytest.raises(ValueError):
        tree.validate(folder + "/none")


def test_bundles(spark, folder):
    # T9: no nesting; of equal names the first wins
    files = tree.read_tree(spark, folder).cache()
    roots, again = diff.first_wins(tree.bundle_roots(files), ["org", "bundle_key"])
    assert {r.root_path for r in roots.collect()} == {"lwc/cardView", "lwc/childRow"}
    assert [r.ignored_path for r in again.collect()] == ["lwc/other/childrow"]
    keys = {(r.bundle_key, r.file_key) for r in tree.bundle_files(files, roots).collect()}
    assert ("cardview", "__tests__/cardview.test.js") in keys and ("childrow", ".hidden") in keys


def test_snapshots_of_two_folders(spark, folder, tmp_path):
    (tmp_path / "Alone.cls").write_text("public class Alone { }\n")
    (tmp_path / "Rate.cls").write_bytes(FILES["classes/Rate.cls"].encode())
    sides = []
    for path, name in ((folder, "a"), (str(tmp_path), "b")):
        files = tree.class_files(tree.read_tree(spark, path, name)).withColumn("key", F.lower("name"))
        sides.append(diff.first_wins(files, ["key"])[0])
    got = {r.key: r for r in diff.with_stats(diff.match(*sides, ["key"])).collect()}
    assert got["alone.cls"].status == "modified" and got["rate.cls"].status == "identical" and got["job.cls"].status == "only_in_org_a"


def test_kinds_of_edges(edges):
    kinds = {k: e.kind for k, e in edges.items()}
    assert kinds["apex:ledger", "apex:posting"] == "implements"
    assert kinds["apex:subledger", "apex:ledger"] == "extends"
    assert kinds["lwc:cardview", "apex:ledger"] == "apex_imperative" and kinds["lwc:cardview", "apex:ledger::open!1"] == "apex_imperative"
    assert ("lwc:cardview", "lwc:childrow") in kinds
    assert kinds["apex:ledger::init!0", "apex:rate::apply!1"] == "instance_call" and ("apex:ledger::init!0", "apex:rate::apply!2") not in kinds
    assert kinds["apex:ledger.entry::go!0", "apex:ledger::init!0"] == "static_call"
    assert kinds["apex:watch", "apex:audit::log!1"] == "static_call"


def test_fan_out(edges):
    assert edges["apex:audit::log!1", "apex:subledger::post!1"].kind == "possible_implementation"
    assert edges["apex:ledgertest::t!0", "apex:subledger::post!1"].kind == "possible_override"
    assert ("apex:ledger::open!1", "apex:subledger::post!1") not in edges  # a new object's type is known


def test_no_class_loops_from_own_calls(edges):
    assert ("apex:ledger", "apex:ledger") not in edges
    assert edges["apex:ledger::loopA!0", "apex:ledger::loopB!0"].kind == "self_call"


def test_nodes(nodes):
    assert nodes["apex:kinds"].type == "apex_class"  # T13
    assert nodes["apex:alone"].in_degree == nodes["apex:alone"].out_degree == 0
    assert nodes["apex:ledger.entry.inner"].name == "Ledger.Entry.Inner" and nodes["apex:ledger.entry"].parent_id == "apex:ledger"
    assert nodes["apex:ledgertest"].is_test and nodes["apex:ledgertest::t!0"].is_test
    assert nodes["apex:rate::apply!2"].name == "Rate.apply(2 args)"
    assert nodes["apex:audit::extra!0"].file_path == "classes/deep/audit.cls"  # T36: all files' methods


def test_entry_points(nodes):
    assert nodes["apex:ledger::open!1"].entry_point_reason == "@AuraEnabled"
    assert nodes["apex:ledger::start!1"].entry_point_reason == "Batchable.start"
    assert nodes["apex:job::execute!1"].entry_point_reason == "Queueable.execute"


def test_dead_code(built):
    got = {(r.bucket, r.id) for r in views.dead_code(built.nodes).collect()}
    assert {("dead", "apex:rate::apply!2"), ("dead", "apex:audit::unused!0"), ("dead", "apex:one::a!0"), ("test_only", "apex:ledger::loopA!0"), ("test_only", "apex:ledger::loopB!0")} <= got
    assert not {i for _, i in got} & {"apex:ledger::start!1", "apex:subledger::post!1", "apex:rate::standard!0", "apex:ledgertest::t!0"}


def test_summary(built):
    s = built.summary().first()
    assert (s.apex_interfaces, s.apex_triggers, s.lwc_components, s.test_classes) == (2, 1, 2, 1)
    assert s.duplicate_count == 2 and s.duplicate_names == ["Audit", "childrow"]
    assert {r.name for r in built.unresolved.collect()} == {"Missing", "Batchable", "Queueable", "nowhere"}


def test_false_transitivity(built):
    near, _ = views.blast_radius(built.nodes, built.edges, "One", None, "downstream")
    got = {r.id: (r.hop, r.verified) for r in near.collect()}
    assert got == {"apex:one": (0, True), "apex:two": (1, True), "apex:three": (2, False)}


def test_blast_radius_upstream_and_tests(built):
    near, _ = views.blast_radius(built.nodes, built.edges, "Rate", 1, "upstream")
    assert {r.id: r.direction for r in near.collect()} == {"apex:rate": "focus", "apex:ledger": "upstream"}
    seen = {r.id for r in views.blast_radius(built.nodes, built.edges, "Ledger", 1)[0].collect()}
    assert "apex:ledgertest" not in seen
    seen = {r.id for r in views.blast_radius(built.nodes, built.edges, "LedgerTest", 1)[0].collect()}
    assert "apex:ledger" in seen  # T29: a test in focus shows tests
    only, _ = views.blast_radius(built.nodes, built.edges, "Rate", 0)  # T30
    assert [r.id for r in only.collect()] == ["apex:rate"]
    assert views.blast_radius(built.nodes, built.edges, "nobody") is None


def test_method_focus(built):
    near, _ = views.blast_radius(built.nodes, built.edges, "apex:ledger::init!0", 1, "downstream")
    assert {r.id for r in near.collect()} == {"apex:ledger::init!0", "apex:rate::Rate!2", "apex:rate::apply!1", "apex:ledger::tidy!0"}


def test_detail(built):
    d = views.node_detail(built.nodes, built.edges, "ledger")
    assert [r.name for r in d["methods"].collect()] == sorted(r.name for r in d["methods"].collect())
    assert all("::" not in r.target for r in d["depends_on"].collect())
    assert "apex:ledgertest" not in {r.source for r in d["used_by"].collect()}
    assert "apex:ledgertest" in {r.source for r in views.node_detail(built.nodes, built.edges, "ledger", True)["used_by"].collect()}
    assert views.node_detail(built.nodes, built.edges, "missing") is None


def test_views_list_occurrences(built):
    """Every view's occurrences are those of the table of occurrences, with file, line and snippet."""
    fields = ("ord", "file", "line", "snippet", "kind", "is_test")
    every = {}
    for r in built.occurrences.orderBy("ord").collect():
        every.setdefault((r.source, r.target), []).append(tuple(r[f] for f in fields))
    for tests in (True, False):
        want = {k: [o for o in v if tests or not o[-1]] for k, v in every.items()}
        detail = views.node_detail(built.nodes, built.edges, "ledger", tests)
        shown = {"graph": (views.get_graph(built.nodes, built.edges, include_test=tests)[1], 5), "near": (views.blast_radius(built.nodes, built.edges, "Ledger", 1, include_test=tests)[1], 5), "out": (detail["depends_on"], 10), "in": (detail["used_by"], 10)}
        for edges, limit in shown.values():
            got = edges.collect()
            assert got
            for r in got:
                own = want[r.source, r.target]
                assert [tuple(o[f] for f in fields) for o in r.occurrences] == own[:limit] and (r.occurrence_count, r.truncated) == (len(own), len(own) > limit)
        source, target = max(every, key=lambda k: len(every[k]))
        found = views.edge_occurrences(built.nodes, built.occurrences, source, target, tests).collect()
        assert [tuple(r[f] for f in fields) for r in found] == want[source, target]
    assert views.edge_occurrences(built.nodes, built.occurrences, "nobody", "ledger") is None


def test_degrees_sum_to_edges(built):
    n = built.edges.count()
    s = built.nodes.agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert (s[0], s[1]) == (n, n)


def test_scripts_and_templates(spark):
    script = "import a from '@salesforce/apex/ns.Rate.get';\nimport b from '@salesforce/apex/Audit.log';\nimport d from '@salesforce/apex/Audit.open';\n// import z from '@salesforce/apex/Audit.z';\nimport k from 'c/kid';\nimport o from 'c/own';\n@wire( a, {}) x; // b()\na(1); d (2); let s = 'b()';\n"
    page = "<c-my-kid></c-my-kid><C-my-kid-/>\n<!-- <c-my-kid/>\n --> <c-my-kid>\n<c-own></c-own><c-none>"
    parts = spark.createDataFrame([(1, "lwc:own", "own/own.js", "own.js", script), (2, "lwc:own", "own/own.html", "own.html", page), (3, "lwc:own", "own/__tests__/own.js", "__tests__/own.js", script)], "file_seq long, self_id string, file string, file_key string, content string")
    classes = spark.createDataFrame([("rate", "apex:rate"), ("audit", "apex:audit")], "name_lc string, id string")
    components = spark.createDataFrame([("kid", "lwc:kid"), ("own", "lwc:own"), ("mykid", "lwc:mykid")], "name_lc string, id string")
    got = [(r.file_seq, r.occ_seq, r.target, r.kind, r.callee, r.line, r.detail) for r in org.script_references(parts, classes, components).orderBy("file_seq", "occ_seq").collect()]
    assert got == [
        (1, 1, "apex:rate", "apex_wire", "get", 1, "imported as `a`, calls Rate.get()"),
        (1, 2, "apex:audit", "apex_unused_import", None, 2, "imported as `b`, calls Audit.log()"),
        (1, 3, "apex:audit", "apex_imperative", "open", 3, "imported as `d`, calls Audit.open()"),
        (1, 4, "lwc:kid", "js_import", None, 5, "imported as `k`"),
    ]
    got = [(r.file_seq, r.target, r.kind, r.line, r.detail, r.snippet) for r in org.template_references(parts, components).orderBy("occ_seq").collect()]
    assert got == [(2, "lwc:mykid", "composition", 1, "<c-my-kid>", "<c-my-kid></c-my-kid><C-my-kid-/>"), (2, "lwc:mykid", "composition", 3, "<c-my-kid>", "--> <c-my-kid>")]


def test_counted_edges_equal_those_of_occurrences(spark, built):
    """Fan-out by rules gives the edges of all occurrences, where sources have one rule, several, or refer to a target otherwise."""
    columns = ["source", "target", "kind", "n_occ", "n_prod", "kind_prod", "first_ord"]
    assert sorted(map(tuple, built.counted.select(*columns).collect()), key=repr) == sorted(map(tuple, built.edges.select(*columns).collect()), key=repr)


def test_nodes_and_counts_make_no_occurrences(spark, folder):
    found = org.build(tree.read_tree(spark, folder))
    found.names.count(), found.summary().count(), found.counted.count()
    assert not {"occurrences", "edges", "nodes"} & set(vars(found))
