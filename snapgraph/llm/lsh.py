"""Classes of similar items from banded signatures, exact for all candidates.

A bucket is the set of items with an equal band. Its pivot, the smallest item,
is compared with every other member; what is similar joins one component, so a
group of n copies costs n comparisons, not n * n. Large groups whose members are
then in different components get a second, more central pivot, the member most
like the first. Where members are still apart, all similarities in the group,
but for the pivot's, are computed at once, in blocks, as products of matrices of
members by shared elements; only what joins different components leaves the task.

Bands are packed by slices of their hash, so buckets meet as arrays and not row by
row. What a task holds of a hot bucket is packed apart and dealt out on its own,
large groups by pairs of blocks. Items are longs.

Defined cases: no signatures or none that meet give no classes; repeated rows of
an item count once; items without elements are similar to each other only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import unionfind
from snapgraph.llm.words import U, mix, small

#: Rows of a lookup table of a few longs that may be broadcast, some 50 MB; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Comparisons with one item that a task makes before another task takes over.
SPLIT = 512

#: From texts to (elements, weights, ptr): text i has the distinct elements ptr[i] to ptr[i + 1], sorted.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray]
Elements = Callable[[pa.Array], Sets]


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join a written table, by broadcast if it has few rows."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


#: A key that stands in this share of a table's rows, or more, is never joined by shuffle.
HOT = 10_000


def sized_join(rows: DataFrame, table: DataFrame, on: str, size: str) -> DataFrame:
    """Inner join with a written table that tells how many rows each key has.

    Keys of 1 / HOT of all these rows or more, HOT of them at most, are sent to
    every task, so no task gets a hot key's rows; the others are shuffled, at
    every size alike.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= total / HOT
    if table.where(hot).isEmpty():
        return rows.join(table.hint("merge"), on)
    heavy = F.broadcast(table.where(hot))
    return rows.join(heavy, on).union(rows.join(heavy, on, "left_anti").join(table.where(~hot).hint("merge"), on))


#: Parts that buckets are dealt into by a hash of their band, pairs (band, node) that a task packs at once, and
#: members of one bucket among these from which they stay together and apart from the rest of the bucket.
SLICES, PACK, MANY = 2048, 1 << 20, 1024
_MEMBERS, _FIRST, _APART = 0, 1, 2


def _longs(column: pa.Array) -> np.ndarray:
    """All longs of a column of packed longs, behind each other."""
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]].view(np.int64)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Longs as binaries; item i packs the next counts[i] of them and is null where it has none."""
    lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(counts * 8))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return lists if (counts > 0).all() else lists.take(pa.array(np.arange(len(counts)), mask=counts == 0))


def _packs(slices: np.ndarray, kind: int, ptr: np.ndarray, band: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows (slice, kind, band, node); row i packs the pairs ptr[i] to ptr[i + 1]."""
    columns = [pa.array(slices, pa.int32()), pa.array(np.full(len(slices), kind), pa.int32()), *(packed(x, np.diff(ptr)) for x in (band, node))]
    return pa.RecordBatch.from_arrays(columns, ["slice", "kind", "band", "node"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bands) to packed pairs (band, node) by slices of bands.

    Of a bucket with MANY members here, these are packed apart, into any slice; its own slice is told the first of them.
    """

    def out(band: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = (mix(band.view(U)) % U(SLICES)).astype(np.uint16)
        ordered = np.sort(band)
        last = ordered[MANY - 1 :]  # of each MANY in a row
        many = np.unique(last[last == ordered[: len(last)]])
        if len(many):
            at = np.minimum(np.searchsorted(many, band), len(many) - 1)
            apart = np.flatnonzero(many[at] == band)
            apart = apart[np.argsort(at[apart], kind="stable")]
            ptr = np.concatenate(([0], np.cumsum(np.bincount(at[apart], minlength=len(many)))))
            first = np.minimum.reduceat(node[apart], ptr[:-1])
            yield _packs((mix(many.view(U) ^ first.view(U)) % U(SLICES)).astype(np.int32), _APART, ptr, band[apart], node[apart])
            yield _packs((mix(many.view(U)) % U(SLICES)).astype(np.int32), _FIRST, np.arange(len(many) + 1), many, first)
            rest = many[at] != band
            own, band, node = own[rest], band[rest], node[rest]
        order = np.argsort(own, kind="stable")  # by radix
        own = own[order]
        begin = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint16(1)))
        yield _packs(own[begin].astype(np.int32), _MEMBERS, np.append(begin, len(own)), band[order], node[order])

    held, n = [], 0
    for batch in batches:
        lists = batch.column(1)
        if pa.types.is_binary(lists.type):
            band, counts = _longs(lists), pc.divide(pc.binary_length(lists), 8)
        else:
            band, counts = lists.flatten().to_numpy(), lists.value_lengths()
        held.append((band, np.repeat(batch.column(0).to_numpy(), counts.fill_null(0).to_numpy())))
        n += len(held[-1][0])
        if n >= PACK:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs sorted by slice to (band, pivot, node, piece); of buckets packed apart each part's first member is told as a piece."""

    def rows(band: np.ndarray, pivot: np.ndarray, node: np.ndarray, piece: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(band), pa.array(pivot), pa.array(node), pa.array(np.full(len(band), piece))], ["band", "pivot", "node", "piece"])

    def out(band: np.ndarray, node: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(band)
        ordered = band[order]
        same = ordered[1:] == ordered[:-1]
        met = order[np.append(same, False) | np.append(False, same)]  # most bands have one member
        met = np.append(met, np.flatnonzero(np.isin(band, told))) if len(told) else met
        if not len(met):
            return
        band, node = band[met], node[met]
        order = np.lexsort((node, band))
        band, node = band[order], node[order]
        new = np.append(True, band[1:] != band[:-1])
        pivot = node[new][np.cumsum(new) - 1]
        keep = ~new & np.append(False, node[1:] != node[:-1])
        yield rows(band[keep], pivot[keep], node[keep], False)
        if len(told):
            piece = new & np.isin(band, told)
            yield rows(band[piece], pivot[piece], pivot[piece], True)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    told: list[np.ndarray] = []
    last = None

    def slice_out() -> Iterator[pa.RecordBatch]:
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)), np.unique(np.concatenate(told or [np.zeros(0, np.int64)])))

    for batch in batches:
        if not batch.num_rows:
            continue
        slices, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(slices) | np.diff(kinds)) + 1, len(slices)).tolist()
        at = 0
        for cut in cuts:
            if slices[at] != last:
                yield from slice_out()
                held, told, last = [], [], slices[at]
            for i, j in ((k, k + 1) for k in range(at, cut)) if kinds[at] == _APART else ((at, cut),):
                band, node = (_longs(batch.column(c).slice(i, j - i)) for c in (2, 3))
                if kinds[at] != _APART:
                    held.append((band, node))
                    if kinds[at] == _FIRST:
                        told.append(band)
                    continue
                node = np.unique(node)
                yield rows(np.full(len(node) - 1, band[0]), np.full(len(node) - 1, node[0]), node[1:], False)
                yield rows(band[:1], node[:1], node[:1], True)
            at = cut
    yield from slice_out()


def stars(signatures: DataFrame) -> DataFrame:
    """Distinct (a, b), written: a is the pivot of a bucket with b in it, from (node, bands).

    bands: array<long>, or binary as `packed` makes it.
    """
    pairs = signatures.select("node", "bands").mapInArrow(_pack, "slice int, kind int, band binary, node binary")
    dealt = pairs.repartition("slice").sortWithinPartitions("slice", "kind")
    runs = scratch.keep(dealt.mapInArrow(_runs, "band long, pivot long, node long, piece boolean"), "runs")
    most = scratch.tasks(signatures.sparkSession, runs.count())
    # few buckets have pieces: each has MANY members in one task at least
    heads = runs.where("piece").groupBy("band").agg(F.min("pivot").alias("head"), F.max("pivot").alias("high")).where("head <> high").drop("high")
    heads = scratch.keep(heads, "heads", most=most)
    # a piece of a bucket that goes on is a member like the others
    pairs = lookup(runs, heads, "band", "left").select(F.coalesce("head", "pivot").alias("a"), F.col("node").alias("b"))
    return scratch.keep(pairs.where("a <> b").distinct(), "stars", most=most)


def _keyed(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Elements told apart by group."""
    return h + group.astype(U) * U(0x9E3779B97F4A7C15)


def _owners(ptr: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def _even(sets: Sets) -> bool:
    return bool((sets[1] == 1).all())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct elements share."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.count_nonzero(a[np.minimum(a.searchsorted(b), len(a) - 1)] == b)) if len(b) else 0


def jaccard(left: Sets, right: Sets, partner: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each of `right` to its partner in `left`; 1 if both are empty."""
    h, w, ptr = left
    n = len(right[2]) - 1
    if _even(left) and _even(right):
        shared = np.fromiter((_common(h[ptr[p] : ptr[p + 1]], right[0][a:b]) for p, a, b in zip(partner.tolist(), right[2][:-1].tolist(), right[2][1:].tolist(), strict=True)), np.float64, n)
        union = np.diff(ptr)[partner] + np.diff(right[2]) - shared
        return np.where(union > 0, shared / np.where(union > 0, union, 1), 1.0)
    key = _keyed(h, _owners(ptr))
    order = np.argsort(key)  # keys of one set are distinct
    key, weight = key[order], w[order]
    owner = _owners(right[2])
    mine = _keyed(right[0], partner[owner])
    shared = np.zeros(n)
    if len(key) and len(mine):
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        hit = np.flatnonzero(key[at] == mine)
        shared = np.bincount(owner[hit], np.minimum(weight[at[hit]], right[1][hit]), n)
    total = np.bincount(owner, right[1], n) + np.bincount(_owners(ptr), w, len(ptr) - 1)[partner]
    union = total - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 1.0)


def select(sets: Sets, rows: np.ndarray) -> Sets:
    """The sets of some rows."""
    h, w, ptr = sets
    n = ptr[rows + 1] - ptr[rows]
    new = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(new[-1]) + np.repeat(ptr[rows] - new[:-1], n)
    return h[at], w[at], new


def join(parts: list[Sets]) -> Sets:
    """Several sets of sets behind each other."""
    sizes = [np.diff(ptr) for _, _, ptr in parts]
    return np.concatenate([h for h, _, _ in parts]), np.concatenate([w for _, w, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def compare(pairs: DataFrame, texts: DataFrame, elements: Elements) -> DataFrame:
    """(a, b, similarity) of each pair (a, b), from texts (node, text).

    The rows of an item a that is compared often are split over tasks; each task
    reads a's text once, then streams the others'.
    """
    per = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("salts")), "per", most=scratch.tasks(pairs.sparkSession, pairs.count()))
    named = texts.select(F.col("node"), "text")
    left = per.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = left.join(named, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = lookup(pairs, per, "a", "inner").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    right = right.join(named, F.col("b") == F.col("node")).select("a", "salt", "b", "text")
    dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U), np.zeros(0), np.zeros(2, np.int64))  # the a at the end of the rows before
        for part in small(batches):
            sets = elements(part.column(3))
            first = part.column(2).is_null().to_numpy(zero_copy_only=False)
            own, others = np.flatnonzero(first), np.flatnonzero(~first)
            left = join([held, select(sets, own)])
            found = jaccard(left, select(sets, others), np.cumsum(first)[others])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(others)), part.column(2).take(pa.array(others)), pa.array(found)], ["a", "b", "similarity"])
            held = select(left, np.array([len(own)]))

    return dealt.mapInArrow(rows, "a long, b long, similarity double")


#: Members of a group in one block, their bytes of text, and elements in one product; the size from which a group gets a second pivot.
BLOCK, BYTES, COLUMNS, CENTRAL = 1024, 16 << 20, 2048, 1024


def _open(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(pivot, node, similarity, root) of the pivots whose other members are in different components, written."""
    placed = lookup(members.select("pivot", "node", "similarity"), labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.keep(placed, "placed", most=most)
    apart = placed.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pivot")
    return scratch.keep(lookup(placed, scratch.keep(apart, "apart", most=most), "pivot", "left_semi"), "open", most=most)


def _bounds(sets: Sets, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Upper bounds of the weight that left and right share, lower bounds of their union, and whether both are exact.

    The product of roots of weights bounds the shared weight from above and is
    equal to it where an element weighs the same in both sets.
    """
    h, weight, ptr = sets
    owner = _owners(ptr)
    total = np.bincount(owner, weight, len(ptr) - 1)
    _, column, n = np.unique(h, return_inverse=True, return_counts=True)
    shared = n > 1  # others meet nothing
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    keep = column >= 0
    owner, column, weight = owner[keep], column[keep], weight[keep]
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    even = not len(weight) or bool((weight == 1).all())
    bound = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(ptr) - 1, -1)
    rows = np.concatenate((left, right)) if left is not right else left
    place[rows] = np.arange(len(rows))
    a, b = (slice(0, len(left)), slice(len(left), None)) if left is not right else (slice(None), slice(None))
    for begin in range(0, int(shared.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, (begin, begin + COLUMNS)))
        x = np.zeros((len(rows), COLUMNS), np.float32)
        x[place[owner[some]], column[some] - begin] = np.sqrt(weight[some])
        bound += x[a] @ x[b].T
    return bound, total[left][:, None] + total[right][None, :] - bound, even


#: Sets on a side, at most, that are compared pair by pair and not as a product.
FEW = 16


def _few(sets: Sets, left: list[int], right: list[int], threshold: float, root: list[int]) -> list[tuple[int, int]]:
    """What `joins` finds, for few sets of equal weights, pair by pair; sizes too unlike rule a pair out."""
    h, _, ptr = sets
    own = {i: h[ptr[i] : ptr[i + 1]] for i in {*left, *right}}
    out = []
    for x in left:
        for y in right:
            if root[x] == root[y]:
                continue
            low, high = sorted((len(own[x]), len(own[y])))
            if high and low / high < threshold:
                continue
            shared = _common(own[x], own[y])
            if not high or shared / (low + high - shared) >= threshold:
                out.append((x, y))
                to, old = root[x], root[y]
                root = [to if r == old else r for r in root]
    return out


def joins(sets: Sets, left: np.ndarray, right: np.ndarray, threshold: float, root: np.ndarray) -> list[tuple[int, int]]:
    """Links of left x right at the threshold that join all components that any such link joins; root: each set's component.

    Pairs that only the bound lets through are verified, the likely ones first;
    those whose sets have been joined meanwhile are left out.
    """
    if len(left) <= FEW and len(right) <= FEW and _even(sets):
        return _few(sets, left.tolist(), right.tolist(), threshold, root.tolist())
    bound, union, even = _bounds(sets, left, right)
    likely = bound >= threshold * union - (1e-6 if even else 1e-3 * (1 + union))
    i, j = np.nonzero(likely & (root[left][:, None] != root[right][None, :]))
    order = np.argsort(-bound[i, j] / np.maximum(union[i, j], 1e-9), kind="stable")
    i, j, root, out = left[i[order]], right[j[order]], root.copy(), []
    while len(i):
        u, v = i[:1024], j[:1024]
        good = np.ones(len(u), bool) if even else jaccard(select(sets, u), select(sets, v), np.arange(len(u))) >= threshold
        for x, y in zip(u[good].tolist(), v[good].tolist(), strict=True):
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[y]] = root[x]
        i, j = i[1024:], j[1024:]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return out


def _blocks(members: DataFrame, texts: DataFrame, elements: Elements, threshold: float) -> DataFrame:
    """(a, b): links that join components, from members (pivot, node, root) of groups; at most one a member and block."""
    sized = members.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    per = sized.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BYTES)).cast("int").alias("blocks"))
    per = scratch.keep(per, "per", most=scratch.tasks(members.sparkSession, members.count()))
    rows = lookup(members, per, "pivot", "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(texts.select("node", "text"), "node")
    rows = rows.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "text")
    dealt = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "own", "node")

    def links(own: np.ndarray, node: np.ndarray, root: np.ndarray, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        first = own == own[0]
        left = np.flatnonzero(first)
        found = joins(sets, left, left if first.all() else np.flatnonzero(~first), threshold, root)
        return node[[a for a, _ in found]], node[[b for _, b in found]]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sets: list[Sets] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                own, node, root = (np.concatenate(x) for x in zip(*held, strict=True))
                if (root != root[0]).any():
                    a, b = links(own, node, root, join(sets))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in small(batches, 512):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            own, node, root = (batch.column(c).to_numpy() for c in (3, 4, 5))
            found = elements(batch.column(6))
            cuts = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, batch.num_rows)
            at = 0
            for cut in cuts.tolist():
                key = tuple(keys[at].tolist())
                if key != last:
                    yield from out()
                    held, sets, last = [], [], key
                held.append((own[at:cut], node[at:cut], root[at:cut]))
                sets.append(select(found, np.arange(at, cut)))
                at = cut
        yield from out()

    return dealt.mapInArrow(match, "a long, b long")


def joined(labels: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(node, root), written, of components (node, root) and further links (a, b) between their nodes or others.

    Only the components that links join are sought anew, each by its root.
    """
    roots = labels.select("node", "root")
    for side in ("a", "b"):
        known = roots.withColumnsRenamed({"node": side, "root": "root_" + side})
        links = lookup(links, known, side, "left").withColumn(side, F.coalesce("root_" + side, side)).drop("root_" + side)
    links = scratch.keep(links.where("a <> b"), "between", most=most)
    if links.isEmpty():
        return labels
    moved = scratch.keep(unionfind.components(links), "moved", most=most)
    found = lookup(labels, moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    # what is moved may be a component's root, which has its row already, or a node that had no component
    return scratch.keep(found.union(lookup(moved, labels.select("node"), "node", "left_anti")), "labels", most=most)


def classes(signatures: DataFrame, texts: Callable[[DataFrame], DataFrame], elements: Elements, threshold: float) -> DataFrame:
    """(node, root) for each node that is linked with another; links reach `threshold` in weighted Jaccard similarity.

    texts: from a written table of nodes to their (node, text).
    """
    pairs = stars(signatures)
    most = scratch.tasks(pairs.sparkSession, pairs.count())  # of tables with a row a pair
    nodes = scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes", most=most)
    known = scratch.keep(texts(nodes), "texts")
    scores = scratch.keep(compare(pairs, known, elements), "scores")
    links = scores.where(F.col("similarity") >= threshold).select("a", "b")
    labels = scratch.keep(unionfind.components(links), "labels", most=most)

    apart = _open(scores.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "similarity"), labels, most)
    sizes = scratch.keep(apart.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") >= CENTRAL).select("pivot"), "sizes", most=most)
    if not sizes.isEmpty():
        center = lookup(apart, sizes, "pivot", "inner").groupBy("pivot").agg(F.max_by(F.struct("node", "root"), F.struct("similarity", "node")).alias("c"))
        center = scratch.keep(center.select("pivot", F.col("c.node").alias("a"), F.col("c.root").alias("center")), "center", most=most)
        second = lookup(apart, center, "pivot", "inner").where("root <> center").select("a", F.col("node").alias("b")).distinct()
        second = scratch.keep(second.join(pairs, ["a", "b"], "left_anti"), "second", most=most)
        links = scratch.keep(compare(second, known, elements), "scores").where(F.col("similarity") >= threshold).select("a", "b")
        labels = joined(labels, links, most)
        apart = _open(apart, labels, most)
    return joined(labels, scratch.keep(_blocks(apart.select("pivot", "node", "root"), known, elements, threshold), "joins"), most)
