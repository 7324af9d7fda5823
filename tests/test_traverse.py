"""Searches by bits, components by contraction, and relations that only grow, against plain loops."""

import random

from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.operators import rounds, traverse

PAIRS = "at string, to string"


def reached(start, moves, depth):
    seen, frontier = set(start), set(start)
    for _ in range(depth):
        frontier = {b for a, b in moves if a in frontier} - seen
        seen |= frontier
    return seen


def test_many_searches_share_words(spark):
    """More sources than bits of a word, depths, masks of pairs."""
    random.seed(5)
    ids = [f"n{i:03}" for i in range(150)]
    moves = {(random.choice(ids), random.choice(ids)) for _ in range(260)}
    sources = traverse.numbered(spark.createDataFrame([(i,) for i in ids], "id string"))
    rows = {r.id: (r.block, r.mask) for r in sources.collect()}
    assert len(set(rows.values())) == 150 and {b for b, _ in rows.values()} == {0, 1, 2}
    pairs = spark.createDataFrame(list(moves), PAIRS).withColumn("mask", F.lit(-1).cast("long"))
    for depth in (0, 1, 2, 400):
        found = scratch.keep(traverse.spread(sources, pairs, depth if depth < 400 else None), "found")
        want = {i: reached({i}, moves, depth) for i in ids}
        got = {(r.id, r.block): r.mask for r in found.collect()}
        for i, (block, mask) in rows.items():
            assert {x for (x, b), m in got.items() if b == block and m & mask} == want[i]
        assert {r.id: r.n for r in traverse.by_source(found, sources, "n").collect()} == {i: len(w) for i, w in want.items()}


def test_bits_go_over_pairs_that_hold_them(spark):
    seeds = spark.createDataFrame([("a", 0, 3), ("x", 0, 2), ("x", 0, 1)], "id string, block int, mask long")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 3), ("c", "a", 3), ("x", "c", 2), ("c", "d", 2)], "at string, to string, mask long")
    assert {r.id: r.mask for r in traverse.spread(seeds, pairs).collect()} == {"a": 3, "b": 1, "c": 3, "d": 2, "x": 3}
    assert traverse.spread(seeds.limit(0), pairs).count() == 0


def test_long_chains_and_hubs(spark, monkeypatch):
    """A path, a star whose hub has most edges, a ring and nodes without edges; few rounds."""
    monkeypatch.setattr(rounds, "HOT", 20)
    path = [f"p{i:05}" for i in range(3000)]
    edges = list(zip(path, path[1:], strict=False)) + [("hub", f"s{i:04}") for i in range(2000)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r2", "r2")]
    random.seed(6)
    random.shuffle(edges)
    ids = sorted({x for e in edges for x in e} | {"alone"})
    counted = []
    star = traverse._star
    monkeypatch.setattr(traverse, "_star", lambda e, large: counted.append(large) or star(e, large))
    got = {r.id: r.component for r in traverse.components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, PAIRS).repartition(6)).collect()}
    want = {i: "p00000" if i[0] == "p" else "hub" if i[0] in "hs" else "r0" if i[0] == "r" else i for i in ids}
    assert got == want
    assert len(counted) <= 2 * 14  # 3000 nodes in a path


def test_relations_grow_in_few_tables(spark):
    grown = rounds.Growing(spark.range(5), "grown")
    for n in (1, 1, 40, 3, 2, 1, 1, 100, 1):
        grown.add(spark.range(n), n)
    assert grown.all().count() == 155 and len(grown.tables) <= 3
    sizes = [n for _, n in grown.tables]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and [t.count() for t, _ in grown.tables] == sizes


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(rounds, "HOT", 10)
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [("none", 1)], "k string, v int")
    table = scratch.keep(rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")), "sized")
    joined = rounds.sized_join(rows, table, "k", "n")
    assert sorted(tuple(r) for r in joined.select("k", "v", "top").collect()) == sorted(tuple(r) for r in rows.join(table, "k").select("k", "v", "top").collect())
    assert "Union" in joined._jdf.queryExecution().executedPlan().toString()


def test_wide_words_count_what_single_words_count(spark):
    """More searches than a row of words holds, each to its own count."""
    from pyspark.sql import functions as F

    from snapgraph.operators import traverse

    n = 700
    sources = traverse.numbered(spark.range(n).select(F.format_string("n%04d", "id").alias("id")))
    moves = [(f"n{i:04}", f"n{j:04}", -1) for i in range(n) for j in (i + 1, i * 7 % n) if j < n]
    pairs = spark.createDataFrame(moves, "at string, to string, mask long")
    found = traverse.spread(traverse.wide(sources), pairs, 2, traverse.wide_masks())
    assert found.select("block").distinct().count() == 2
    got = {r.id: r.shown for r in traverse.by_source(traverse.narrow(found), sources, "shown").collect()}
    to = {}
    for a, b, _ in moves:
        to.setdefault(a, set()).add(b)
    one = {a: {a} | to.get(a, set()) for a in (f"n{i:04}" for i in range(n))}
    assert got == {a: len(set().union(*(one[b] for b in one[a]))) for a in one}
