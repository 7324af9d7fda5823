"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text's n-grams are its words and word pairs, hashed into 8,192 cells, and runs
of one to four symbols of its outline (capital, letter, digit or the mark
itself, repeats written once), hashed into 4,096; words that repeat one of the
eight before them add n-grams of their own. The raw model counts all documents,
the target model those labelled as good. A document's log weight is the sum over
its n-grams of log(target / raw), with the target smoothed by n-grams of the raw
model, fewer for outlines and repeats than for words.

A level is chosen between the labelled good and bad documents, k is how many of
all documents reach it, and the sample are the k largest of log weight plus
Gumbel noise, which is seeded by doc_id. The k-th largest is found exactly, by
counting ever finer cells of the keys' bits; equal keys are in or out together.

Defined cases: a null text is empty, and an empty text has log weight 0; rows
that repeat a doc_id draw the same noise; a null doc_id draws noise of its own
kind; of equal keys all or none are kept; without labelled good or without
labelled bad documents all are kept; an empty table gives an empty result; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lsh
from snapgraph.llm.words import U, Words, mix, small, words

WORD_CELLS, OUTLINE_CELLS, REPEAT_CELLS = 1 << 13, 1 << 12, 1 << 8
CELLS = WORD_CELLS + OUTLINE_CELLS + REPEAT_CELLS
#: N-grams of the raw model that smooth the target's words, outlines and repeats: fewer where there are fewer cells.
SMOOTH, SMOOTH_OUTLINES, SMOOTH_REPEATS = 1e6, 1e5, 1e4
BACK = 8
#: Cells between the least and the largest labelled weight among which the level is looked for.
CUTS = 1 << 16

# the symbol of each byte: capitals, letters and non-ASCII bytes, digits, white space; marks stand for themselves
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
_SYMBOL[0x41:0x5B] = ord("A")
_SYMBOL[0x30:0x3A] = ord("0")
_SYMBOL[[9, 11, 12, 13, 32]] = 32


def cells(found: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of all n-grams of a group of texts; raw: the group's bytes before lower-casing, joined likewise."""
    n = len(found.ptr) - 1
    owner = np.repeat(np.arange(n), np.diff(found.ptr))
    h = found.hashes
    same = owner[1:] == owner[:-1]
    pairs = mix(h[:-1] * U(3) + h[1:])[same]
    parts = [(h & U(WORD_CELLS - 1), owner), (pairs & U(WORD_CELLS - 1), owner[1:][same])]
    # which of the words before a word are equal to it
    flags = np.zeros(len(h), np.int64)
    for k in range(1, min(BACK, len(h) - 1) + 1):
        flags[k:] |= ((h[k:] == h[:-k]) & (owner[k:] == owner[:-k])).astype(np.int64) << (k - 1)
    hit = np.flatnonzero(flags)
    parts.append(((flags[hit] & (REPEAT_CELLS - 1)).astype(U) + U(WORD_CELLS + OUTLINE_CELLS), owner[hit]))
    symbols = _SYMBOL[raw]
    turn = np.ones(len(symbols), bool)
    turn[1:] = symbols[1:] != symbols[:-1]
    at = np.flatnonzero(turn)
    line, text = symbols[at].astype(U), np.searchsorted(found.begin, at, "right") - 1
    total = np.zeros(len(line), U)
    for k in range(4):
        m = len(line) - k
        if m <= 0:
            break
        total[:m] = total[:m] * U(257) + line[k : k + m] + U(1)
        inside = text[:m] == text[k : k + m]
        parts.append((mix(total[:m][inside] + U(k << 40)) % U(OUTLINE_CELLS) + U(WORD_CELLS), text[:m][inside]))
    return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])


def grams(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, cells, owners) for groups of texts."""
    for found in words(texts):
        n = len(found.ptr) - 1
        raw = "\n".join(t or "" for t in texts[found.first : found.first + n]).encode("utf-8", "replace") + b"\n"
        yield found.first, n, *cells(found, np.frombuffer(raw, np.uint8))


def counts(docs: DataFrame) -> np.ndarray:
    """N-gram counts of all documents and of the good ones, 2 x CELLS, from (text, good); a table of fixed size on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in small(batches):
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, _, cell, owner in grams(batch.column(0).to_pylist()):
                total[:CELLS] += np.bincount(cell, minlength=CELLS)
                total[CELLS:] += np.bincount(cell[good[owner + first]], minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = docs.select("text", "good").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * CELLS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(2, CELLS)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of each cell; words, outlines and repeats are models of their own."""
    out = np.zeros(CELLS)
    for a, b, smooth in ((0, WORD_CELLS, SMOOTH), (WORD_CELLS, WORD_CELLS + OUTLINE_CELLS, SMOOTH_OUTLINES)):
        q = (raw[a:b] + 0.5) / (raw[a:b] + 0.5).sum()
        p = (target[a:b] + smooth * q) / (target[a:b].sum() + smooth)
        out[a:b] = np.log(p / q)
    # repeats: their rate a word, in target and raw text
    a = WORD_CELLS + OUTLINE_CELLS
    q = (raw[a:] + 0.5) / (raw[:WORD_CELLS].sum() + 1)
    p = (target[a:] + SMOOTH_REPEATS * q) / (target[:WORD_CELLS].sum() + SMOOTH_REPEATS)
    out[a:] = np.log(p / q)
    return out


def _noise(doc_id: int | None, seed: str) -> float:
    digest = hashlib.md5(f"{doc_id}:{seed}".encode()).digest()
    return float(-np.log(-np.log((int.from_bytes(digest[:8], "big") + 0.5) / 2.0**64)))


def _bits(key: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    raw = key.view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)


def score(docs: DataFrame, labels: DataFrame, seed: str = "quality") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, label, log_weight, key, bits) of every document, written; and the log ratios."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    known = scratch.keep(known, "known", fewer=True)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = lsh.lookup(plain, known, "doc_id", "left")
    raw, target = counts(joined.select("text", F.coalesce(F.col("label") == 1, F.lit(False)).alias("good")))
    ratios = log_ratios(raw, target)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            weights = np.zeros(batch.num_rows)
            for first, n, cell, owner in grams(batch.column(2).to_pylist()):
                weights[first : first + n] = np.bincount(owner, sent.value[cell], minlength=n)[:n]
            key = weights + np.array([_noise(d, seed) for d in batch.column(0).to_pylist()])
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(weights), pa.array(key), pa.array(_bits(key))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "label", "log_weight", "key", "bits"])

    rows = joined.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "label")
    return scratch.keep(rows.mapInArrow(weigh, "doc_id long, text_hash long, label int, log_weight double, key double, bits long"), "scored"), ratios


def level(scored: DataFrame) -> float:
    """The log weight that best parts good from bad labelled documents, each side by its share; in the middle of where it may lie.

    From counts in CUTS equal cells between the least and the largest labelled
    weight. Without both sides: minus infinity.
    """
    known = scored.where("label is not null")
    low, high = known.agg(F.min("log_weight"), F.max("log_weight")).first()
    if low is None:
        return float("-inf")
    width = max((high - low) / CUTS, 1e-9)
    cell = F.floor((F.col("log_weight") - low) / width).cast("int")
    found = known.groupBy(cell.alias("cell")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("bad")).toArrow().to_pylist()
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    if not good or not bad:
        return float("-inf")
    best, at, lost, caught, before = -1.0, float("-inf"), 0, 0, None
    for r in sorted(found, key=lambda r: r["cell"]):
        # the level lies above the cells seen so far, at this cell's lower edge at most
        value = 1 - lost / good + caught / bad
        if value > best + 1e-12:
            best, at = value, float("-inf") if before is None else low + width * (before + 1 + r["cell"]) / 2
        lost, caught, before = lost + r["good"], caught + r["bad"], r["cell"]
    return at


def kth_largest(scored: DataFrame, k: int) -> int:
    """The k-th largest of the column bits, by counting cells of 16 bits at a time; at most 65,536 counts reach the driver."""
    low = -(2**63)
    for shift in (48, 32, 16, 0):
        upper = F.shiftright(F.col("bits"), shift)
        rows = scored if shift == 48 else scored.where(F.shiftright(F.col("bits"), shift + 16) == low >> (shift + 16))
        found = sorted(((r["c"], r["n"]) for r in rows.groupBy(upper.alias("c")).agg(F.count("*").alias("n")).toArrow().to_pylist()), reverse=True)
        for c, n in found:
            if n >= k:
                low = c << shift
                break
            k -= n
    return low


def sample(docs: DataFrame, labels: DataFrame, seed: str = "quality") -> DataFrame:
    """(doc_id, text_hash, log_weight, key) of the documents that are kept, a row each."""
    scored, _ = score(docs, labels, seed)
    floor = level(scored)
    k = scored.where(F.col("log_weight") >= floor).count()
    if not k:
        return scored.where("false").select("doc_id", "text_hash", "log_weight", "key")
    return scored.where(F.col("bits") >= kth_largest(scored, k)).select("doc_id", "text_hash", "log_weight", "key")


def keep(docs: DataFrame, labels: DataFrame, seed: str = "quality") -> DataFrame:
    """The documents that are kept, with all their columns."""
    kept = scratch.keep(sample(docs, labels, seed).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "kept", fewer=True)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_own_hash"))
    on = F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_own_hash") == F.col("_hash"))
    few = kept.count() <= lsh.BROADCAST_ROWS
    return rows.join(F.broadcast(kept) if few else kept, on, "left_semi").select("_row.*")
