"""Line deduplication over a corpus, fuzzy by MinHash.

Lines are compared lower-cased and trimmed, as sets of shingles of eight
characters (a shorter line is one shingle). A one-permutation MinHash of 30 bins,
empty ones filled from others, is cut into 10 bands of 3; candidates are
verified by exact Jaccard similarity of 0.8 or more, and a distributed
union-find joins what is similar. Of each component one line stays: the first
one of the smallest document that holds any, in the order of (doc_id, hash of
the text).

Bands miss a pair at 0.8 with probability 8e-4, at 0.85 with 7e-5.

Defined cases: blank lines are never compared and stay; a null text stays null,
an empty one empty; a text whose lines all go becomes empty, the document stays;
different texts under one doc_id, or under none, are documents of their own,
equal rows get equal results; a null doc_id comes after all others; an empty
table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lsh
from snapgraph.llm.words import U, mix, part, small, sums

CHARS, THRESHOLD = 8, 0.8
BANDS, ROWS = 10, 3
BINS = BANDS * ROWS
_LAST = 2**63 - 1
#: Of tables of lines and bands, which repeat little: the writer's quickest level, and no dictionaries.
_BULKY = {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary#line": "false", "parquet.enable.dictionary#bands": "false"}
_EMPTY = np.uint32(0xFFFFFFFF)
#: Bytes of text that are hashed at once.
GROUP = 1 << 17
#: For each bin the bins from which it is filled when empty, in the order they are tried.
_PROBES = (mix(np.arange(BINS * 64, dtype=U) + U(77)) % U(BINS)).astype(np.int64).reshape(BINS, 64)


def _blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, shingle hashes, owners) for groups of texts; shingles repeat as they stand, an empty text has none.

    Eight one-byte characters are their own number, before blending; others are
    hashed by the group's prefix sums.
    """
    if not len(texts):
        return
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole_data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = [0]
    while cuts[-1] < len(texts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offset, offset[cuts[-1]] + GROUP, "right")) - 1))
    for i, j in zip(cuts, cuts[1:], strict=False):
        n, begin = j - i, offset[i : j + 1] - offset[i]
        length = np.diff(begin)
        data = np.concatenate((whole_data[offset[i] : offset[j]], np.zeros(CHARS, np.uint8)))
        text = data[: begin[-1]]
        eight = np.ndarray(len(text) + 1, "<u8", data, 0, (1,))
        if length.min() >= CHARS and not (text & 0x80).any():
            whole = np.ones(len(text), bool)
            for k in range(1, CHARS):  # no shingle reaches over a text's end
                whole[begin[1:] - k] = False
            yield n, _blend(eight[:-1][whole]), np.repeat(np.arange(n), length - CHARS + 1)
            continue
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        chars = np.searchsorted(starts, begin)
        count = np.diff(chars)
        shingles = np.where(count >= CHARS, count - CHARS + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(n), shingles)
        at = np.arange(len(owner)) + np.repeat(chars[:-1] - np.cumsum(shingles) + shingles, shingles)
        start, ends = starts[at], np.append(starts, len(text))
        stop = ends[np.minimum(at + CHARS, chars[owner + 1])]
        odd = np.flatnonzero(stop - start != CHARS)
        h = _blend(eight[start])
        if len(odd):
            h[odd] = part(sums(text), start[odd], stop[odd])
        yield n, h, owner


def elements(texts: pa.Array) -> lsh.Sets:
    """Each text's distinct shingles, sorted, with equal weights."""
    hashes, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for n, h, owner in _hashed(texts):
        end = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        for a, b in zip([0, *end], end, strict=False):  # values alone, a text at a time, sort fastest
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        hashes.append(h[new])
        counts.append(np.bincount(owner[new], minlength=n))
    h = np.concatenate(hashes)
    return h, np.ones(len(h)), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def bands(texts: pa.Array) -> np.ndarray:
    """The band hashes of each non-empty text, texts x BANDS."""
    out = np.zeros((len(texts), BANDS), np.int64)
    plain = pc.and_(pc.string_is_ascii(texts), pc.greater_equal(pc.binary_length(texts), CHARS)).to_numpy(zero_copy_only=False)
    for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):  # long texts of one-byte characters take a shorter way
        out[some] = _bands(texts.take(pa.array(some)))
    return out


def _bands(texts: pa.Array) -> np.ndarray:
    out = []
    for n, h, owner in _hashed(texts):
        flat = np.full(n * BINS, _EMPTY, np.uint32)
        place = ((h >> U(32)) * U(BINS) >> U(32)).view(np.int64)
        place += owner * BINS
        np.minimum.at(flat, place, h.astype(np.uint32) >> np.uint32(1))
        signature = flat.reshape(n, BINS).astype(U)
        full = signature != U(_EMPTY)
        r, c = np.nonzero(~full)
        step = 0
        while len(r) and step < _PROBES.shape[1]:
            source = _PROBES[c, step]
            good = full[r, source]
            signature[r[good], c[good]] = signature[r[good], source[good]] + U((step + 1) << 32)
            r, c, step = r[~good], c[~good], step + 1
        for i, j in zip(r.tolist(), c.tolist(), strict=True):  # whatever no probe has met: the first full bin
            signature[i, j] = signature[i, np.flatnonzero(full[i])[0]] + U(1 << 40)
        parts = signature.reshape(n, BANDS, ROWS)
        total = np.broadcast_to(np.arange(BANDS, dtype=U) + U(1), (n, BANDS)).copy()
        for i in range(ROWS):
            total = total * U(0x9E3779B97F4A7C15) + mix(parts[:, :, i] + U(i))
        out.append(mix(total))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, BANDS), np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_hash, line_no, node, line) to the same with bands; line and bands only where a node is new to the task."""
    seen: set[int] = set()
    for batch in small(batches, 2048):
        if len(seen) > 1 << 18:  # repeats are dropped again later; this only saves work
            seen.clear()
        nodes, line = batch.column(3).to_pylist(), batch.column(4)
        own = [i for i, k in enumerate(nodes) if not (k in seen or seen.add(k))]
        found = bands(line.take(pa.array(own, pa.int64())))
        new = np.zeros(len(nodes), np.int64)
        new[own] = BANDS
        line = line.take(pa.array(np.arange(len(new)), mask=new == 0))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), line, lsh.packed(found.reshape(-1), new)], ["doc", "text_hash", "line_no", "node", "line", "bands"])


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, removed array<int>): the places of the lines to go, for (doc_id, text) rows that have any."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    whole = docs.where("text is not null").select(doc, F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))  # once a text, not once a line
    rows = whole.select("doc", "text_hash", F.posexplode(_split(F.col("text"))).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''").select("doc", "text_hash", "line_no", F.xxhash64("line").alias("node"), "line")
    # each task signs a line once and keeps its text there, so no later step splits texts again
    signed = scratch.keep(rows.mapInArrow(_sign, "doc long, text_hash long, line_no int, node long, line string, bands binary"), "signed", options=_BULKY)

    def texts(nodes: DataFrame) -> DataFrame:
        return lsh.lookup(signed.where("line is not null").select("node", F.col("line").alias("text")), nodes, "node", "left_semi").dropDuplicates(["node"])

    labels = lsh.classes(signed.where("bands is not null").select("node", "bands"), texts, elements, THRESHOLD)
    place = F.struct("doc", "text_hash", "line_no")
    places = signed.select("node", place.alias("place"))
    per = places.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    rooted = lsh.lookup(per, labels, "node", "left").where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first")
    most = scratch.tasks(docs.sparkSession, signed.count())  # of tables with a row a line at most
    rooted = scratch.keep(rooted, "rooted", most=most)
    stays = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("stays")), "stays", most=most)
    special = scratch.keep(lsh.lookup(rooted.select("node", "root"), stays, "root", "inner").select("node", "stays"), "special", most=most)
    spare = lsh.lookup(places, special, "node", "inner").where("place <> stays").select("place.*")
    return scratch.keep(spare.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("removed")), "removed", most=most)


def _without(docs: DataFrame) -> DataFrame:
    """docs as _row, with _text (the lines that stay), _n and _removed."""
    removed = removed_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    keyed = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")
    )
    joined = lsh.lookup(keyed, removed, ["doc", "text_hash"], "left")
    lines = _split(F.col("_row.text"))
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(rest)
    n = F.octet_length("_row.text") - F.octet_length(F.replace(F.col("_row.text").cast("string"), F.lit("\n"), F.lit(""))) + 1  # without splitting what stays whole
    return joined.select("_row", text.alias("_text"), n.alias("_n"), F.coalesce(F.array_sort("removed"), F.array().cast("array<int>")).alias("_removed"))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, removed (line numbers from 0) and the text that stays."""
    out = _without(docs.select("doc_id", "text"))
    n = F.when(F.col("_row.text").isNull(), 0).otherwise(F.col("_n"))
    return out.select("_row.doc_id", n.cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"), F.col("_text").alias("text"))


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay as text, n_chars (if there is one) their number of characters; other columns as they came."""
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return _without(docs).select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])
