"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words, a shorter text is one shingle. A shingle's
weight is its count in the text times its IDF, log2(1 + N / df). Consistent
weighted samples, as many as bands times rows, are banded; candidates are
verified by exact weighted Jaccard similarity of 0.8 or more. Classes are the
components of links. Sampling, which only proposes candidates, takes the IDF in
whole bits, 1 at least, so that a table of its random numbers can be kept;
similarities take it as it is.

df counts documents, but a large group of likely copies only about once: else
what thousands of copies share would weigh less than each copy's own edits, and
the group would fall apart. Likely copies are texts that share one of eight
keys, each made of four least hashes of their shingles, so of texts that have a
passage in common, a share p of each, only p^4 meet in a key. Groups are folded
from LARGE documents on, at any N. The table of large groups stays bounded, as
beyond N = LARGE * FOLD documents it takes N / FOLD of them; a smaller group is
then a small part of what its cell, below, holds anyway: leaving it unfolded
changes a weight by log2(1 + 2^18 / (m * FOLD)) bits at most, 0.28 at m = 300.

df is counted in 2^18 hashed cells, a table of fixed size: at m distinct
shingles a text a cell holds N * m / 2^18 others. So shingles in fewer documents
than that share one weight, about log2(2^18 / m) at every N, and only more
frequent ones are told apart, by N / df, at every N alike.

Bands: 28 of 5 rows; a pair at 0.8 is missed with probability 2e-5.

Defined cases: equal texts are always in one class, whatever they hold; texts
without words are similar to equal texts only; null texts count as one class of
their own; a class's id is its smallest doc_id, null if it has none; rows that
repeat a doc_id keep rows of their own; an empty table gives an empty result;
extra columns pass through `dedupe`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lsh
from snapgraph.llm.words import U, mix, shingles, small, words

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
CELLS, TABLE = 1 << 18, 1 << 12
#: Keys of a text and least hashes in each; documents from which a group with a key is folded, or a share of all; the unit of folded counts.
KEYS, HASHES, LARGE, FOLD, UNIT = 8, 4, 64, 1 << 12, 1 << 24
SEED = 20240
_LAST = 2**63 - 1


def _counted(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, ptr, shingles, counts) for groups of texts; the shingles of each are distinct and sorted."""
    for found in words(texts):
        h, owner = shingles(found, WORDS)
        n = len(found.ptr) - 1
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(h)))
        yield found.first, n, np.searchsorted(owner[at], np.arange(n + 1)), h[at], counts


class Sampler:
    """Consistent samples of weighted sets; random numbers come from a table by the element's hash and the sample."""

    def __init__(self, idf: np.ndarray, samples: int = BANDS * ROWS) -> None:
        draw = np.random.Generator(np.random.PCG64(SEED))
        shape = (TABLE, samples)
        self.r = draw.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = draw.random(shape, np.float32)
        self.idf, self.samples = idf, samples
        self.levels = np.maximum(np.rint(idf), 1).astype(np.uint8)
        self._once: dict[int, np.ndarray] = {}
        self._slot = np.arange(samples, dtype=U) * U(0x9E3779B97F4A7C15)

    def weights(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf[(h & U(CELLS - 1)).astype(np.int64)].astype(np.float64)

    def _sampled(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.levels[(h & U(CELLS - 1)).astype(np.int64)].astype(np.float64)

    def _logs(self, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        r = self.r[row]
        t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + self.beta[row])
        return self.log_c[row] - r * (t - self.beta[row]) - r

    def _level(self, level: int) -> np.ndarray:
        """The values of all table rows for a count of 1 at a level."""
        if level not in self._once:
            self._once[level] = self._logs(np.arange(TABLE), np.full(TABLE, float(level)))
        return self._once[level]

    def samples_of(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A hash of (element, t) for each sample; h is sorted, so ties go to the smallest element."""
        row = (h >> U(40)).astype(np.int64) & (TABLE - 1)
        level = self.levels[(h & U(CELLS - 1)).astype(np.int64)]
        best, who = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.int64)
        for at in range(0, len(h), 4096):
            some = slice(at, at + 4096)
            values = np.empty((len(h[some]), self.samples), np.float32)
            for one in np.unique(level[some]):
                here = np.flatnonzero(level[some] == one)
                values[here] = self._level(int(one))[row[some][here]]
            many = np.flatnonzero(counts[some] > 1)
            if len(many):
                values[many] = self._logs(row[some][many], self._sampled(h[some][many], counts[some][many]))
            least = values.min(0)
            i, j = np.nonzero(values == least)
            first = np.empty(self.samples, np.int64)
            first[j[::-1]] = i[::-1]
            better = least < best
            best[better], who[better] = least[better], first[better] + at
        r, beta = self.r[row[who], np.arange(self.samples)], self.beta[row[who], np.arange(self.samples)]
        t = np.floor(np.log(self._sampled(h[who], counts[who])).astype(np.float32) / r + beta)
        return mix(h[who] + t.astype(np.int64).astype(U) * U(0xD1B54A32D192ED03) + self._slot)

    def bands(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        parts = self.samples_of(h, counts).reshape(BANDS, ROWS)
        total = np.arange(BANDS, dtype=U)
        for i in range(ROWS):
            total = total * U(0x9E3779B97F4A7C15) + parts[:, i]
        return mix(total).astype(np.int64)


_HASHES = np.random.Generator(np.random.PCG64(SEED + 1)).integers(0, 1 << 64, (2, HASHES * KEYS), U, False)


def keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and the keys of each: of texts at plain similarity s, each key is shared with probability s^4."""
    some = np.flatnonzero(ptr[1:] > ptr[:-1])
    if not len(some):
        return some, np.zeros((0, KEYS), np.int64)
    out = np.tile(np.arange(KEYS, dtype=U), (len(some), 1))
    for i, (a, b) in enumerate(_HASHES.T):
        out[:, i % KEYS] = mix(out[:, i % KEYS] * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ a) * (b | U(1)), ptr[some]))
    return some, out.view(np.int64)


def large_groups(docs: DataFrame, total: int) -> dict[int, int]:
    """The number of documents with each key that LARGE documents and 1 / FOLD of all have; KEYS * FOLD keys at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for found in words(batch.column(0).to_pylist()):
                h, owner = shingles(found, WORDS)
                _, every = keys(h, np.searchsorted(owner, np.arange(len(found.ptr))))
                yield pa.RecordBatch.from_arrays([pa.array(every.reshape(-1))], ["key"])

    found = docs.select("text").mapInArrow(rows, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return {r["key"]: r["n"] for r in found.where(F.col("n") >= max(LARGE, -(-total // FOLD))).toArrow().to_pylist()}


def idf(docs: DataFrame) -> np.ndarray:
    """log2(1 + N / df) for each hashed cell, counted over all documents; a table of fixed size on the driver."""
    total = docs.count()
    folded = large_groups(docs, total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in small(batches):
            for _, n, ptr, h, _ in _counted(batch.column(0).to_pylist()):
                unit = np.full(n, UNIT, np.int64)
                if folded:
                    some, every = keys(h, ptr)
                    unit[some] = [UNIT // max(folded.get(k, 1) for k in own) for own in every.tolist()]
                np.add.at(cells, (h & U(CELLS - 1)).astype(np.int64), np.repeat(unit, np.diff(ptr)))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    found = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(CELLS)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy() / UNIT
    return np.log2(1 + max(total, 1) / np.maximum(df, 1)).astype(np.float32)


_samplers: dict[int, Sampler] = {}


def _sampler(found: np.ndarray) -> Sampler:
    key = hash(found.tobytes())
    if key not in _samplers:
        _samplers.clear()
        _samplers[key] = Sampler(found)
    return _samplers[key]


def node(text: Column) -> Column:
    """The 64-bit hash by which equal texts meet; among n different texts, n * n / 2^65 pairs are expected to collide."""
    return F.xxhash64(text)


def label(docs: DataFrame) -> DataFrame:
    """(doc, node, class), written: a row for each of docs' (doc_id, text), class being a node of the class."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), node(F.col("text")).alias("node"))
    sent = docs.sparkSession.sparkContext.broadcast(idf(docs.select(F.col("text").cast("string").alias("text"))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, seen = _sampler(sent.value), set()
        for batch in small(batches):
            if len(seen) > 1 << 16:  # repeats are dropped again later; this only saves work
                seen.clear()
            nodes = batch.column(0).to_numpy()
            own = [i for i, k in enumerate(nodes.tolist()) if not (k in seen or seen.add(k))]
            texts = [batch.column(1)[i].as_py() for i in own]
            for first, n, ptr, h, counts in _counted(texts):
                some = [i for i in range(n) if ptr[i + 1] > ptr[i]]
                rows = [sampler.bands(h[ptr[i] : ptr[i + 1]], counts[ptr[i] : ptr[i + 1]]) for i in some]
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[[own[first + i] for i in some]].astype(np.int64)), bands], ["node", "bands"])

    signed = scratch.keep(plain.where("text is not null").select("node", "text").mapInArrow(sign, "node long, bands array<long>"), "signed")

    def elements(texts: pa.Array) -> lsh.Sets:
        sampler = _sampler(sent.value)
        parts = [(h, sampler.weights(h, counts), ptr) for _, _, ptr, h, counts in _counted(texts.to_pylist())]
        return lsh.join(parts) if parts else (np.zeros(0, U), np.zeros(0), np.zeros(1, np.int64))

    narrow = plain.select(F.coalesce("doc", F.lit(_LAST)).alias("doc"), "node")
    first = narrow.groupBy("node").agg(F.min("doc").alias("doc"))

    def texts(nodes: DataFrame) -> DataFrame:
        """One document of each node; documents are found by id, so a text's many copies don't meet in a task."""
        wanted = scratch.keep(lsh.lookup(first, nodes, "node", "left_semi"), "wanted", fewer=True)
        named = plain.withColumn("doc", F.coalesce("doc", F.lit(_LAST)))
        return lsh.lookup(named, wanted, ["node", "doc"], "left_semi").select("node", "text").dropDuplicates(["node"])

    labels = lsh.classes(signed, texts, elements, THRESHOLD)
    joined = lsh.lookup(narrow, labels.withColumnRenamed("root", "class"), "node", "left")
    return scratch.keep(joined.select("doc", "node", F.coalesce("class", "node").alias("class")), "labelled", fewer=True)


def _doc(doc: Column) -> Column:
    return F.when(doc != _LAST, doc)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the class's smallest doc_id), class_size (rows), and whether it stands for its class."""
    labelled = label(docs)
    by = scratch.keep(labelled.groupBy("class").agg(F.min("doc").alias("least"), F.count("*").alias("class_size")), "by")
    out = lsh.sized_join(labelled, by, "class", "class_size")
    return out.select(_doc(F.col("doc")).alias("doc_id"), _doc(F.col("least")).alias("class_id"), "class_size", (F.col("doc") == F.col("least")).alias("representative"))


def dedupe(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest (doc_id, hash of the text), with all its columns.

    What goes is decided on ids and hashes; whole rows are only filtered.
    """
    labelled = label(docs).groupBy("class", "doc", "node").agg(F.count("*").alias("n"))
    labelled = scratch.keep(labelled, "counted")
    by = labelled.groupBy("class").agg(F.min(F.struct("doc", "node")).alias("stays"), F.count("*").alias("size")).where("size > 1")
    gone = lsh.sized_join(labelled, scratch.keep(by, "by"), "class", "size").where("struct(doc, node) <> stays").select("doc", "node")
    gone, again = scratch.keep(gone, "gone", fewer=True), scratch.keep(labelled.where("n > 1").select("doc", "node"), "again", fewer=True)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), node(F.col("text").cast("string")).alias("node"))
    kept = lsh.lookup(rows, gone, ["doc", "node"], "left_anti")
    if again.isEmpty():
        return kept.select("_row.*")
    once = lsh.lookup(kept, again, ["doc", "node"], "left_anti")
    return once.union(lsh.lookup(kept, again, ["doc", "node"], "left_semi").dropDuplicates(["doc", "node"])).select("_row.*")
