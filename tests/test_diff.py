import random

import pytest
from pyspark.sql import functions as F

from snapgraph.functions import text
from snapgraph.functions.difflines import opcodes, stats
from snapgraph.operators import diff
from snapgraph.sources import sinks

SNAPSHOT = "key string, name string, content string, size_bytes long, error string"


def compared(spark, a, b):
    sides = [spark.createDataFrame([(k, k.upper(), c, 1, e) for k, c, e in rows], SNAPSHOT) for rows in (a, b)]
    return {r.key: r for r in diff.with_stats(diff.match(*sides, ["key"])).collect()}


def test_statuses_and_counts(spark):
    got = compared(
        spark,
        [("same", "x\n", None), ("mod", "a\nb\n", None), ("gone", "1\n2\n3", None), ("bad", "", "denied"), ("end", "a", None), ("empty", "", None)],
        [("same", "x\n", None), ("mod", "a\nc\nd\n", None), ("new", "1\n", None), ("bad", "", "denied"), ("end", "a\n", None), ("empty", "", None)],
    )
    assert {k: (r.status, r.lines_added, r.lines_removed) for k, r in got.items()} == {
        "same": ("identical", 0, 0),
        "mod": ("modified", 2, 1),
        "gone": ("only_in_org_a", 0, 3),
        "new": ("only_in_org_b", 1, 0),
        "bad": ("modified", 0, 0),  # T4: an unreadable file is never identical
        "end": ("modified", 1, 1),  # T6: a final newline is a difference
        "empty": ("identical", 0, 0),
    }
    assert got["bad"].has_error and not got["mod"].has_error


def test_ratcliff_obershelp_not_longest_subsequence():
    # T5: the matcher finds 2 equal lines where a longest common subsequence has 3
    a, b = "\n".join("cbcacac"), "\n".join("aabacbb")
    assert stats(a, b)[0] == 5
    assert all(o[0] in ("equal", "replace", "insert", "delete") for o in opcodes(a, b))


def test_lines_counted_without_patterns(spark):
    """Patterns took most of the time of comparing texts; counts are those of splitlines for any order of terminators."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029\r\né\u2027") for _ in range(rng.randrange(14))) for _ in range(400)] + ["", "\r\n", "\n\r", "\r\r\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.n_lines(F.col("t")).alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [len(t.splitlines()) for t in texts]
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan


def test_line_terminators_as_splitlines(spark):
    # T7
    random.seed(5)
    alphabet = ["a", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "é"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(8))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", text.n_lines(F.col("t")).alias("n")).orderBy("i").collect()] == [len(t.splitlines()) for t in texts]


def test_decoding(spark):
    # T1, T2
    raw = bytearray(b"a\r\nb\rc\xff\xfe\xe2\x82z")
    df = spark.createDataFrame([(raw,)], "b binary")
    assert df.select(text.decode_utf8(F.col("b")).alias("t")).first().t == bytes(raw).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def test_first_wins_and_duplicates(spark):
    items = spark.createDataFrame([("a", "A.cls", "x/A.cls", 2), ("a", "a.cls", "a.cls", 1), ("b", "b.cls", "b.cls", 3)], "key string, name string, rel_path string, seq long")
    kept, again = diff.first_wins(items, ["key"])
    assert {r.rel_path for r in kept.collect()} == {"a.cls", "b.cls"}
    assert [tuple(r) for r in again.collect()] == [("a", "A.cls", "a.cls", "x/A.cls")]


def test_roll_up(spark):
    files = spark.createDataFrame(
        [("m", "modified", 1, 2, 3, False), ("m", "identical", 0, 0, 0, True), ("i", "identical", 0, 0, 0, False), ("a", "only_in_org_a", 0, 4, 4, False)],
        "bundle_key string, status string, lines_added int, lines_removed int, lines_changed int, has_error boolean",
    )
    both = spark.createDataFrame([(k, k) for k in "mie"], "bundle_key string, name string")
    got = {r.bundle_key: r for r in diff.roll_up(files, both.union(spark.createDataFrame([("a", "A")], both.schema)), both).collect()}
    assert {k: (r.status, r.file_count, r.lines_changed, r.has_error) for k, r in got.items()} == {
        "m": ("modified", 2, 3, True),
        "i": ("identical", 1, 0, False),
        "a": ("only_in_org_a", 1, 4, False),
        "e": ("identical", 0, 0, False),
    }


def test_filters_are_literal(spark):
    df = spark.createDataFrame([("A_b", "modified"), ("axb", "modified"), ("100%", "identical")], "name string, status string")
    assert [r.name for r in diff.filtered(df, q=" a_B ").collect()] == ["A_b"]
    assert [r.name for r in diff.filtered(df, q="%").collect()] == ["100%"]
    assert diff.filtered(df, status="unknown").count() == 0
    assert diff.histogram(df.limit(0)).first().total == 0


def test_order_by_rank_and_locale(spark):
    df = spark.createDataFrame([("b", "identical"), ("Z", "modified"), ("a", "modified"), ("c", "only_in_org_b"), ("d", "only_in_org_a")], "name string, status string")
    assert [r.name for r in diff.by_rank(df).collect()] == ["a", "Z", "d", "c", "b"]


def test_deploy_files(spark):
    names = spark.createDataFrame([("b.CLS",), ("A'<&>.cls",), ("w.trigger",), ("b.CLS",)], "name string")
    assert sinks.text_of(sinks.deploy_list(names)) == "A'<&>.cls\nb.CLS\nw.trigger\n"
    members = "".join(f"        <members>{m}</members>\n" for m in ("A'&lt;&amp;&gt;", "b", "w.trigger"))
    assert sinks.text_of(sinks.manifest(names)) == (
        '<?xml version="1.0" encoding="UTF-8"?>\n<Package xmlns="http://soap.sforce.com/2006/04/metadata">\n    <types>\n'
        + members
        + "        <name>ApexClass</name>\n    </types>\n    <version>59.0</version>\n</Package>\n"
    )


def test_reports():
    page = sinks.item_report({"name": "<x>", "status": "modified", "content_a": "a\nb", "content_b": "a\nc\n"})
    assert "&lt;x&gt;" in page and page.count('class="equal"') == 1 and page.count('class="replace"') == 1
    assert "</script><b" not in sinks.page("t", {"x": "</script><b>"})


@pytest.mark.parametrize("name", ["../x", "a/b", "a\\b"])
def test_names_that_leave_the_folder(name):
    from snapgraph.plans import views

    with pytest.raises(ValueError):
        views.safe_name(name)


def test_parameters():
    from snapgraph.plans import views

    assert views.parse_depth("all") is None and views.parse_depth("3") == 3
    assert views.parse_bool("Yes") and not views.parse_bool("0")
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError):
            views.parse_depth(bad)
    with pytest.raises(ValueError):
        views.parse_direction("sideways")
