"""Impact sizes of two moves by words of hubs, against plain loops over random graphs; what is written does not grow with searches times nodes."""

import glob
import random
import time

import pytest

from snapgraph import scratch
from snapgraph.operators import balls
from snapgraph.plans import views

NODES = "id string, name string, type string, is_test boolean, parent_id string"
EDGES = "source string, target string, kind string, n_prod long, first_ord string"


def ball(starts, moves, allowed):
    seen = frontier = set(starts)
    for _ in range(2):
        frontier = {b for a in frontier for b in moves.get(a, ()) if b in allowed} - seen
        seen = seen | frontier
    return seen


def expected(nodes, edges, direction):
    kind, test, parent = {n[0]: n[2] for n in nodes}, {n[0]: n[3] for n in nodes}, {n[0]: n[4] for n in nodes}

    def moves(some):
        out = {}
        for a, b in some:
            for x, y in [(a, b)] * (direction != "upstream") + [(b, a)] * (direction != "downstream"):
                out.setdefault(x, set()).add(y)
        return out

    plain = moves((e[0], e[1]) for e in edges if e[3])
    real = [(e[0], e[1]) for e in edges if e[3] and e[2] not in ("possible_override", "possible_implementation")]
    live = {n for n in kind if not test[n]}
    types, methods = {n for n in live if kind[n] != "apex_method"}, {n for n in live if kind[n] == "apex_method"}
    out = {}
    for c in (n for n in types if kind[n] == "apex_class"):
        shown = ball({c}, plain, types)
        seeds = {m for m in methods if parent[m] == c} | ({b for a, b in real if a == c and b in methods} if direction != "upstream" else set())
        chained = {c} | {parent[x] or x for x in ball(seeds, moves(real), live)}
        out[c] = (len(shown), len(shown & chained))
    return out


@pytest.mark.parametrize(("hubs", "share"), [(62, 16), (2, 3), (0, 16)])
def test_sizes_of_two_moves(spark, monkeypatch, hubs, share):
    """Nested classes, test nodes, speculative and emptied edges, loops, nodes without edges and edges of unknown ends; many, few and no hubs."""
    monkeypatch.setattr(balls, "HUBS", hubs)
    monkeypatch.setattr(balls, "SHARE", share)
    rng = random.Random(11)
    classes = [f"c{i:02}" for i in range(40)]
    nodes = [(c, c, "apex_class", i % 9 == 8, "c01" if i in (5, 6) else "gone" if i == 7 else None) for i, c in enumerate(classes)]
    nodes += [(f"i{i}", f"i{i}", "apex_interface", False, None) for i in range(4)]
    nodes += [(f"{c}::m{k}", "m", "apex_method", i % 9 == 8, c) for i, c in enumerate(classes) for k in range(3)]
    ids = [n[0] for n in nodes if n[0] not in ("c30", "i3")]
    pairs = {(rng.choice(classes[:30]), f"i{rng.randrange(3)}") for _ in range(50)} | {(rng.choice(ids), rng.choice(ids)) for _ in range(170)} | {("c02", "c02"), ("c03", "unknown"), ("unknown", "c04")}
    kinds = ("static_call", "possible_override", "possible_implementation", "type_reference")
    edges = [(a, b, rng.choice(kinds), rng.choice((0, 1, 2)), f"{k:04}") for k, (a, b) in enumerate(sorted(pairs))]
    tables = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    for direction in ("both", "upstream", "downstream"):
        got = {r.id: (r.shown, r.verified) for r in views.impact_sizes(*tables, 2, direction).collect()}
        assert got == expected(nodes, edges, direction)


def test_searches_that_meet_at_a_hub_write_no_row_for_each(spark, monkeypatch):
    """A star of 3,000 classes: 3,000 searches of 3,001 nodes, in tables of no more than two rows a class."""
    n, most, keep = 3000, [], scratch.keep

    def counted(df, name, *rest, **more):
        kept = keep(df, name, *rest, **more)
        most.append((kept.count(), name))
        return kept

    monkeypatch.setattr(scratch, "keep", counted)
    nodes = spark.createDataFrame([(f"c{i:04}", "c", "apex_class", False, None) for i in range(n)] + [("hub", "hub", "apex_interface", False, None)], NODES)
    edges = spark.createDataFrame([(f"c{i:04}", "hub", "type_reference", 1, f"{i:04}") for i in range(n)], EDGES)
    assert {(r.shown, r.verified) for r in views.impact_sizes(nodes, edges).collect()} == {(n + 1, 1)}
    assert max(most)[0] <= 2 * (n + 1)


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(len(glob.glob(f"{f}/**/shuffle_*.data", recursive=True)) for f in folder)

    spark.range(10).count()
    was, choice = files(), spark.conf.get(scratch.FREED, None)
    kept = scratch.keep(spark.range(50000).repartition(3, "id").groupBy("id").count(), "freed")
    assert kept.count() == 50000
    until = time.time() + 20
    while files() > was + 4 and time.time() < until:  # the last count's own at most; files go in the background
        time.sleep(0.2)
    assert files() <= was + 4
    assert spark.conf.get(scratch.FREED, None) == choice
