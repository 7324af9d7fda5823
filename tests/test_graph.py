import random

import pytest
from pyspark.sql import functions as F

from snapgraph.operators import graph, traverse
from snapgraph.plans import views

OCC = "ord string, source string, target string, kind string, is_test boolean"


def test_dominant_kind(spark):
    rows = [
        ("1", "a", "b", "x", False), ("2", "a", "b", "y", False), ("3", "a", "b", "y", True), ("4", "a", "b", "x", True),  # a tie goes to what is seen first
        ("5", "a", "c", "possible_override", False), ("6", "a", "c", "possible_override", False), ("7", "a", "c", "z", True),  # real ones outvote speculative ones
        ("8", "d", "e", "t", True),
    ]
    got = {(r.source, r.target): (r.kind, r.n_occ, r.n_prod, r.kind_prod) for r in graph.edges(spark.createDataFrame(rows, OCC)).collect()}
    assert got == {("a", "b"): ("x", 4, 2, "x"), ("a", "c"): ("z", 3, 2, "possible_override"), ("d", "e"): ("t", 1, 0, None)}
    assert {(r.source, r.target) for r in graph.production(graph.edges(spark.createDataFrame(rows, OCC))).collect()} == {("a", "b"), ("a", "c")}


def test_first_occurrences(spark):
    rows = [(str(i), "a", "b", "k", False) for i in range(7)] + [("0", "a", "c", "k", False)]
    got = {r.target: (r.occurrence_count, r.truncated, [o.ord for o in r.occurrences]) for r in graph.first_occurrences(spark.createDataFrame(rows, OCC), 5).collect()}
    assert got == {"b": (7, True, list("01234")), "c": (1, False, ["0"])}


def test_occurrences_beside_edges(spark):
    """A hot edge, one of tests alone and one whose tests come first; lists with and without tests."""
    random.seed(4)
    rows = [(f"{i:05}", "a", "b", random.choice("kl"), i % 3 == 0) for i in range(2000)]
    rows += [(f"{i:05}", "a", "c", "k", True) for i in range(3)] + [(f"{i:05}", "d", "c", "k", i < 40) for i in range(60)]
    random.shuffle(rows)
    occ = spark.createDataFrame(rows, OCC).repartition(7)
    edges = graph.with_firsts(graph.edges(occ), occ)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # each task keeps few rows of an edge before they are shuffled
    for tests in (True, False):
        want = {}
        for o, s, t, k, test in sorted(rows):
            if tests or not test:
                want.setdefault((s, t), []).append((o, k, test))
        got = {(r.source, r.target): r for r in views.shown_edges(edges, tests, 5).collect()}
        assert {k: [(o.ord, o.kind, o.is_test) for o in r.occurrences] for k, r in got.items()} == {k: v[:5] for k, v in want.items()}
        assert {k: (r.occurrence_count, r.truncated) for k, r in got.items()} == {k: (len(v), len(v) > 5) for k, v in want.items()}
    with pytest.raises(ValueError):
        graph.listed(edges, 11, True)
    assert views.shown_edges(graph.with_firsts(graph.edges(occ.limit(0)), occ.limit(0)), True).count() == 0
    every = {(r.source, r.target): len(r.occurrences) for r in graph.first_occurrences(occ, None).collect()}
    assert every == {("a", "b"): 2000, ("a", "c"): 3, ("d", "c"): 60}


def test_bfs_labels_and_cycles(spark):
    # T26, T27: first discovery, downstream before upstream, edges in order
    moves = spark.createDataFrame([("f", "x", 0, "2"), ("f", "y", 1, "1"), ("x", "z", 1, "3"), ("y", "z", 0, "4"), ("z", "f", 0, "5")], "at string, to string, way int, ord string")
    seeds = spark.createDataFrame([("f",)], "id string")
    assert {r.id: (r.hop, r.direction) for r in traverse.bfs(seeds, moves).collect()} == {"f": (0, "focus"), "x": (1, "downstream"), "y": (1, "upstream"), "z": (2, "upstream")}
    assert traverse.bfs(seeds, moves, 0).count() == 1
    assert traverse.bfs(seeds.limit(0), moves).count() == 0


def test_components_of_random_graphs(spark):
    random.seed(3)
    ids = [f"n{i:03}" for i in range(120)]
    pairs = [(random.choice(ids), random.choice(ids)) for _ in range(70)] + [(ids[i], ids[i + 1]) for i in range(40)]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = traverse.components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "at string, to string"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in ids}


def test_closure_ends_on_cycles(spark):
    got = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "base string, derived string"))
    assert got.count() == 9


def test_dead_classes_that_something_points_to(spark):
    from snapgraph.plans import views

    nodes = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "id string, fully_dead boolean")
    edges = spark.createDataFrame(
        [("c", "a", "type_reference", "2"), ("c", "a", "static_call", "3"), ("b", "a", "instance_call", "1"), ("a", "b", "static_call", "4"), ("c", "d", "extends", "5")],
        "source string, target string, kind string, first_ord string",
    )
    assert {r.id for r in views.softened_dead(nodes, edges).collect()} == {"a", "d"}
    assert {(r.target, r.source, r.kind) for r in views.why_alive(nodes, edges).collect()} == {("a", "b", "instance_call"), ("b", "a", "static_call")}


def test_visible_nodes_and_focus(spark):
    from snapgraph.plans import views

    nodes = spark.createDataFrame([("a", "Alpha", "apex_class", 5, 1), ("b", "Beta", "apex_class", 0, 1), ("c", "Gamma", "lwc_component", 9, 9)], "id string, name string, type string, in_degree int, out_degree int")
    assert {r.id for r in views.visible(nodes, 2).collect()} == {"a", "c"}
    assert {r.id for r in views.visible(nodes, 2, ["apex_class"], "ALP").collect()} == {"a"}
    around = nodes.where("id <> 'c'").select("id")
    assert {r.id for r in views.visible(nodes, 99, search="zzz", focused=around, focus_id="b").collect()} == {"b"}
    assert {r.id for r in views.visible(nodes, 99, focused=around, focus_id="b").collect()} == {"a", "b"}


def test_kinds_side_by_side_give_the_same_edges(spark):
    kinds = ["possible_override", "static_call", "self_call"]
    rows = [(i % 5, i % 3, (i * 7 + i // 4) % 3, i * 37 % 60, i % 4 == 0) for i in range(60)] + [(9, 9, 0, 100, True), (9, 9, 2, 101, True), (8, None, 0, 102, False)]
    occurrences = spark.createDataFrame(rows, "source long, target long, kind int, ord long, is_test boolean")
    named = occurrences.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1))
    found = graph.numbered_edges(occurrences, ("source", "target"), [F.lit(k) for k in kinds])
    assert sorted(map(str, found.collect())) == sorted(map(str, graph.edges(named).select(found.columns).collect()))
