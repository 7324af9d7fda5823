"""Substring deduplication by sliding spans of sentences.

A sentence is a longest run of words without a full stop, exclamation or
question mark or line break between them. A span is any run of four sentences
(ENOUGH) or more, of whatever length, and any run of two or three that holds 12
words (WORDS). Two or three shorter ones, like "Yes. No." or "A. In. The.", meet
by chance: without the bound one document in six of a corpus of 26,000 would
lose such a pair. One sentence alone is no run, however long. Spans are equal if
their words are (lower-cased, without punctuation). Of each span found more than
once, the first place stays, that of the smallest doc_id and in it the first;
sentences that any other place covers are removed, with the punctuation that
follows them.

Hashed are, from every sentence, the shortest span that begins and the shortest
that ends with it. Within any span these lie one over the other from its first
sentence to its last, and what repeats a span repeats them, so all sentences of
longer repeats are covered too. Spans of equal words that are cut into sentences
in different ways are found as far as a hashed span has both its ends in common.

Defined cases: a null text stays null, an empty one empty; a text without words
has no spans; different texts under one doc_id, or under none, are documents of
their own, equal rows get equal results; a null doc_id comes after all others; an
empty table gives an empty result; extra columns pass through `dedupe`, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lsh
from snapgraph.llm.words import _BASE, _INVERSE, U, Words, _power, mix, small, words

#: The fewest sentences of a span, the words it then holds, and the sentences from which it needs no number of words.
SENTENCES, WORDS, ENOUGH = 2, 12, 4
_LAST = 2**63 - 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def spans(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first byte, last byte + 1) of all spans of a group of texts, and the number of sentences of each text."""
    n = len(found.ptr) - 1
    count = np.diff(found.ptr)
    owner = np.repeat(np.arange(n), count)
    if not len(owner):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(n, np.int64)
    stops = np.cumsum(_STOP[found.data])[found.start]
    new = np.ones(len(owner), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)  # each sentence's first word
    text = owner[first]
    ends = np.append(first[1:], len(owner))
    ptr = np.searchsorted(text, np.arange(n + 1))
    last = ptr[text + 1]  # behind the text's last sentence
    # the sentence behind the span: two sentences with enough words, or enough sentences
    every = np.arange(len(first))
    stop = np.minimum(np.maximum(np.searchsorted(ends, first + WORDS, "left") + 1, every + SENTENCES), every + ENOUGH)
    # the same backwards from each sentence; what begins and ends with the same sentences is hashed once
    back = np.maximum(np.minimum(np.searchsorted(first, ends - WORDS, "right") - 1, every - SENTENCES + 1), every - ENOUGH + 1)
    ahead, behind = np.flatnonzero(stop <= last), np.flatnonzero(back >= ptr[text])
    behind = behind[stop[back[behind]] != behind + 1]
    good = np.concatenate((ahead, back[behind]))
    stop = np.concatenate((stop[ahead], behind + 1))
    begin, behind = first[good], ends[stop - 1]
    prefix = np.zeros(len(owner) + 1, U)
    np.cumsum(found.hashes * _power(_BASE, len(owner)), out=prefix[1:])
    hashes = mix((prefix[behind] - prefix[begin]) * _power(_INVERSE, len(owner))[begin])
    # in bytes a sentence reaches from its first word to the next one's; a text's first and last sentence reach to its ends
    at = found.start[first] - found.begin[text]
    at[ptr[:-1][count > 0]] = 0
    size = np.diff(found.begin) - 1
    upto = np.append(at[1:], 0)
    upto[last - 1] = size[text[last - 1]]
    return text[good], hashes.view(np.int64), at[good], upto[stop - 1], np.diff(ptr)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for found in words(batch.column(2).to_pylist()):
            text, hashes, begin, end, _ = spans(found)
            own = text + found.first
            columns = [hashes, doc[own], key[own], begin.astype(np.int32), end.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["span", "doc", "text_hash", "begin", "end"])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, cuts array<struct<begin, end>>): bytes to be removed, for (doc_id, text) rows that have any."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    rows = docs.where("text is not null").select(doc, F.xxhash64("text").alias("text_hash"), "text")
    found = scratch.keep(rows.mapInArrow(_emit, "span long, doc long, text_hash long, begin int, end int"), "spans")
    many = found.groupBy("span").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).where("n > 1")
    many = scratch.keep(many, "many")
    hits = scratch.keep(lsh.sized_join(found, many, "span", "n"), "hits")
    # of the documents that have the smallest id, and of the places in them, the first stays
    own, place = hits.where("doc = owner"), F.struct("text_hash", "begin")
    firsts = scratch.keep(own.groupBy("span").agg(F.min(place).alias("first"), F.count("*").alias("own")).where("own > 1"), "firsts")
    others = lsh.sized_join(own, firsts, "span", "own").where(place != F.col("first"))
    cuts = hits.where("doc <> owner").select("doc", "text_hash", "begin", "end").union(others.select("doc", "text_hash", "begin", "end"))
    return scratch.keep(cuts.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("cuts")), "cuts")


def _merge(cuts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted((c["begin"], c["end"]) for c in cuts or ()):
        if out and c[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c[1])
        else:
            out.append(list(c))
    return [(a, b) for a, b in out]


_CUT = "text string, n_removed int, removed array<struct<begin:int,end:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, text and cuts, to the text that stays, the number of stretches cut, and those, in bytes of UTF-8."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in small(batches):
        texts, counts, gone = [], [], []
        for text, cuts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            text, merged = text.as_py(), _merge(cuts)
            if merged:
                raw, at, parts = text.encode("utf-8", "replace"), 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            texts.append(text)
            counts.append(len(merged))
            gone.append([{"begin": a, "end": b} for a, b in merged])
        columns = [batch.column(i) for i in range(batch.num_columns - 2)]
        names = [batch.schema.field(i).name for i in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, kind)], [*names, "text", "n_removed", "removed"])


def _cut_rows(docs: DataFrame, row: Column) -> DataFrame:
    """(_row, text, n_removed, removed) of every document."""
    plain = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = repeated(plain.select("doc_id", "text"))
    keyed = plain.select("_row", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(cuts, ["doc", "text_hash"], "left").select("_row", "text", "cuts")
    return joined.mapInArrow(_cut, f"_row {joined.schema['_row'].dataType.simpleString()}, {_CUT}")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the text that stays, n_removed and removed (stretches cut, in bytes of the text's UTF-8)."""
    return _cut_rows(docs, F.col("doc_id").cast("long")).withColumnRenamed("_row", "doc_id")


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with the text that stays; n_chars (if there is one) is its number of characters; other columns as they came."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = _cut_rows(docs, F.struct(*[F.col(f"`{c}`") for c in rest]))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])
