"""Traversals: breadth-first search, reachability, components. Every round is a written table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.operators import positions
from snapgraph.operators.rounds import Growing, sized_join
from snapgraph.schemas import METHOD


def steps(all_edges: DataFrame, nodes: DataFrame, direction: str, include_test: bool, methods: bool, exclude_kinds: tuple[str, ...] = ()) -> DataFrame:
    """(at, to, way, ord): the moves that a traversal may make.

    Tests are left out of the moves, not of the result; excluded kinds are those
    of the edges as they are with tests.
    """
    seen = all_edges.where(~F.col("kind").isin(*exclude_kinds)) if exclude_kinds else all_edges
    if not include_test:
        seen = seen.where("n_prod > 0")
    allowed = nodes
    if not methods:
        allowed = allowed.where(F.col("type") != METHOD)
    if not include_test:
        allowed = allowed.where(~F.col("is_test"))
    down = seen.select(F.col("source").alias("at"), F.col("target").alias("to"), F.lit(0).alias("way"), F.col("first_ord").alias("ord"))
    up = seen.select(F.col("target").alias("at"), F.col("source").alias("to"), F.lit(1).alias("way"), F.col("first_ord").alias("ord"))
    moves = down.union(up) if direction == "both" else down if direction == "downstream" else up
    return moves.join(allowed.select(F.col("id").alias("to")), "to", "left_semi")


def bfs(seeds: DataFrame, moves: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, hop, direction) of everything within `depth` moves of the seeds (id); None is unlimited.

    direction is the side of first discovery: nodes of a hop in the order in
    which they were found, downstream before upstream, edges in order. A node's
    place in its hop stands for the path by which it was found.
    """
    moves = scratch.keep(moves, "moves")
    frontier = scratch.keep(seeds.select("id", F.lit(0).alias("hop"), F.lit("focus").alias("direction"), F.lit(0).cast("long").alias("place")).distinct(), "seen")
    seen, hop = Growing(frontier, "seen"), 0
    while depth is None or hop < depth:
        hop += 1
        found = frontier.join(moves, F.col("id") == F.col("at")).groupBy(F.col("to").alias("id")).agg(F.min(F.struct("place", "way", "ord")).alias("by"))
        found = found.join(seen.all().select("id"), "id", "left_anti")
        found = positions.number(found, [F.col("by"), F.col("id")], "nth")
        found = found.select("id", F.lit(hop).alias("hop"), F.when(F.col("by.way") == 0, "downstream").otherwise("upstream").alias("direction"), F.col("nth").cast("long").alias("place"))
        frontier = scratch.keep(found, "frontier", fewer=True)
        n = frontier.count()
        if not n:
            break
        seen.add(frontier, n)
    return seen.all().select("id", "hop", "direction")


#: Words of 64 searches that go together where there are many searches.
WORDS = 8


def wide(found: DataFrame) -> DataFrame:
    """Rows (id, block, mask) in blocks of WORDS words, the columns `wide_masks`."""
    words = {m: F.when(F.col("block") % WORDS == k, F.col("mask")).otherwise(F.lit(0).cast("long")) for k, m in enumerate(wide_masks())}
    return found.select("id", F.floor(F.col("block") / WORDS).cast("long").alias("block"), *[c.alias(m) for m, c in words.items()])


def narrow(found: DataFrame) -> DataFrame:
    """(block, mask) of what `wide` gives, in blocks of one word again."""
    return found.select("block", F.posexplode(F.array(*wide_masks())).alias("_word", "mask")).where("mask <> 0").select((F.col("block") * WORDS + F.col("_word")).alias("block"), "mask")


def wide_masks() -> list[str]:
    return [f"mask{k}" for k in range(WORDS)]


def spread(seeds: DataFrame, pairs: DataFrame, depth: int | None = None, masks: Sequence[str] = ("mask",)) -> DataFrame:
    """(id, block, mask): the bits that reach each node; from seeds (id, block, mask) over pairs (at, to, mask).

    A bit goes over a pair whose mask holds it; `depth` limits the moves. 64
    searches share a word, blocks of them go side by side; with several masks
    (see `wide`) a block has a word in each. A round carries only the bits that
    are new to a node, and what was found before is never written again as a whole.
    """
    pairs = scratch.keep(pairs.select("at", "to", F.col("mask").alias("_by")), "pairs")
    ors = [F.bit_or(m).alias(m) for m in masks]
    some = reduce(Column.__or__, [F.col(m) != 0 for m in masks])
    new = scratch.keep(seeds.groupBy("id", "block").agg(*ors), "bits")
    seen, hop = Growing(new, "bits"), 0
    while depth is None or hop < depth:
        hop += 1
        found = new.join(pairs, F.col("id") == F.col("at")).select(F.col("to").alias("id"), "block", *[F.col(m).bitwiseAND(F.col("_by")).alias(m) for m in masks])
        found = found.where(some).groupBy("id", "block").agg(*ors)
        known = seen.all().withColumnsRenamed({m: f"_{m}" for m in masks})
        found = found.join(known, ["id", "block"], "left").groupBy("id", "block").agg(*ors, *[F.bit_or(f"_{m}").alias(f"_{m}") for m in masks])
        fresh = [F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"_{m}", F.lit(0).cast("long")))).alias(m) for m in masks]
        new = scratch.keep(found.select("id", "block", *fresh).where(some), "bits", fewer=True)
        n = new.count()
        if not n:
            break
        seen.add(new, n)
    return seen.all().groupBy("id", "block").agg(*ors)


def reach(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) of all that the roots (id) reach over pairs (at, to), the roots included."""
    one = F.lit(1).cast("long")
    return spread(roots.select("id", F.lit(0).alias("block"), one.alias("mask")), pairs.select("at", "to", one.alias("mask"))).select("id")


#: Bits of the two channels of reachability.
ALL, PROD = 1, 2


def method_reachability(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(id, channel) with channel 'all' or 'prod': the methods that something live calls, directly or not.

    Live are entry points, test methods (for 'all' only) and the targets of edges
    from anything that is no method. Both channels are bits of one search.
    """
    kinds = nodes.select("id", "type", "is_test", "entry_point_reason")
    methods = kinds.where(F.col("type") == METHOD)
    into = all_edges.select("source", "target", (F.lit(ALL) + F.when(F.col("n_prod") > 0, PROD).otherwise(0)).cast("long").alias("mask"))
    into = into.join(methods.select(F.col("id").alias("target")), "target", "left_semi")
    among = into.join(methods.select(F.col("id").alias("source")), "source", "left_semi")
    outside = into.join(methods.select(F.col("id").alias("source")), "source", "left_anti")
    entry = F.when(F.col("entry_point_reason").isNotNull(), ALL + PROD).when(F.col("is_test"), ALL).otherwise(0).cast("long")
    roots = methods.select("id", entry.alias("mask")).where("mask <> 0").union(outside.select("target", "mask"))
    found = spread(roots.select("id", F.lit(0).alias("block"), "mask"), among.select(F.col("source").alias("at"), F.col("target").alias("to"), "mask"))
    bits = F.array_compact(F.array(F.when(F.col("mask").bitwiseAND(ALL) != 0, "all"), F.when(F.col("mask").bitwiseAND(PROD) != 0, "prod")))
    return found.select("id", F.explode(bits).alias("channel"))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, block, mask) of sources: each its own bit of a block of 64."""
    placed = positions.number(ids.select("id").distinct(), [F.col("id")])
    return scratch.keep(placed.select("id", F.floor(F.col("place") / 64).cast("long").alias("block"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("mask")), "sources")


def by_source(found: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """(id, name): how many rows of (block, mask) hold each source's bit; sources: see `numbered`. Bits are counted in place, not unfolded."""
    counts = found.groupBy("block").agg(F.array(*[F.sum(F.shiftrightunsigned("mask", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(64)]).alias("_counts"))
    bit = F.expr("cast(log2(cast(shiftrightunsigned(mask, 1) as double) * 2 + (mask & 1L)) + 0.5 as int)")
    return sources.join(counts, "block", "left").select("id", F.coalesce(F.get("_counts", bit), F.lit(0)).cast("long").alias(name))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round of contraction over edges (a, b) with a > b.

    large: every node's larger neighbours move to the least of the node and its
    neighbours; else its smaller neighbours and itself move to the least of them.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least"), F.count("*").alias("n"))
    least = scratch.keep(near.select("u", F.least("u", "least").alias("least"), "n"), "least", fewer=True)
    moved = sized_join(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), least, "u", "n")
    pairs = moved.where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")) if large else moved.where("v <> least").select("v", "least").union(least.select("u", "least"))
    return scratch.keep(pairs.toDF("a", "b").where("a <> b").distinct(), "stars")


def components(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph: the smallest id of each node's component; nodes without edges are their own.

    Alternating contractions to stars; a hub's edges are never brought into one
    task, and the rounds grow with the logarithm of the longest path.
    """
    edges = scratch.keep(pairs.where("at <> to").select(F.greatest("at", "to").alias("a"), F.least("at", "to").alias("b")).distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    was, now = None, state(edges)
    while was != now:
        edges = _star(_star(edges, True), False)
        was, now = now, state(edges)
    return ids.select("id").distinct().join(edges, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
