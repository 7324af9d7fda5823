"""License scans: fuzzy search of short notices in whole texts.

A text's words are the runs of ASCII letters, digits and non-ASCII characters,
A-Z lower-cased; they are compared joined by one space. A notice of n characters
may differ in n // 10 edits. By the pigeonhole principle one of edits + 1 parts
of a notice then stands unchanged in the text: exact searches for the parts
locate the words where a match may begin, and the regex library's bounded-error
matching verifies each and reports its end and edits. Of matches that overlap the
one of the fewest edits stays, then the first. Base notices also count every
exact place. Work grows with the seeds of a text, whatever stands between them.

Defined cases: a null text is empty: no words, no places, null first_word and
last_word, empty labels, score 0; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.words import small

# Base notices and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Further notices and their labels.
MORE = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc"),
    ("all rights reserved", "proprietary"),
)
EDITS_PER = 10

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TABLE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
_TABLE = bytes(_TABLE)


@dataclass(frozen=True)
class Notice:
    phrase: bytes
    label: str
    base: bool
    edits: int
    parts: tuple[tuple[int, bytes], ...]
    pattern: regex.Pattern


def notice(phrase: str, label: str, base: bool) -> Notice:
    edits = len(phrase) // EDITS_PER
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    parts = tuple((a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)) if edits else ((-1, f" {phrase} ".encode()),)
    pattern = regex.compile(rb"(?b)(?:" + regex.escape(phrase, literal_spaces=True).encode() + rb"){e<=%d}(?= )" % edits)
    return Notice(phrase.encode(), label, base, edits, parts, pattern)


NOTICES = tuple(notice(p, label, True) for p, label in BASE) + tuple(notice(p, label, False) for p, label in MORE)


def places(text: bytes, what: bytes) -> list[int]:
    out, at = [], text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1)
    return out


def word_starts(text: bytes) -> list[int]:
    """Where the words of normalised text begin."""
    return (np.flatnonzero(np.frombuffer(text, np.uint8)[:-1] == 32) + 1).tolist()


def fuzzy(text: bytes, n: Notice, starts: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice's matches in normalised text, by seeds and verification."""
    begins: set[int] = set()
    for offset, part in n.parts:
        for at in places(text, part):
            begins.update(starts[bisect_left(starts, at - offset - n.edits) : bisect_right(starts, at - offset + n.edits)])
    found: list[tuple[int, int, int]] = []
    exact, size = n.phrase + b" ", len(n.phrase)
    for start in begins:
        if text.startswith(exact, start):
            found.append((0, start, start + size))
        elif n.edits:
            m = n.pattern.match(text, start, min(len(text), start + size + n.edits + 1))
            if m:
                found.append((sum(m.fuzzy_counts), start, m.end()))
    out: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(found):
        at = bisect_left(out, (start, 0, 0))
        if (not at or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
            insort(out, (start, end, edits))
    return out


def scan(text: str | None) -> dict:
    """Everything found in one text; spans are (first word, words, label, edits)."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    joined = b" %s " % b" ".join(words)
    starts: list[int] = []
    base: list[int] = []
    base_labels, labels, spans, score = set(), set(), [], 0.0
    for n in NOTICES:
        if not any(part in joined for _, part in n.parts):
            continue
        starts = starts or word_starts(joined)
        if n.base:
            exact = [bisect_left(starts, at + 1) for at in places(joined, b" %s " % n.phrase)]
            base += exact
            if exact:
                base_labels.add(n.label)
                score = 1.0
                spans += [(word, n.phrase.count(b" ") + 1, n.label, 0) for word in exact]
        for start, end, edits in fuzzy(joined, n, starts):
            if n.base and edits == 0:
                continue
            labels.add(n.label)
            score = max(score, 1.0 - edits / len(n.phrase))
            spans.append((bisect_left(starts, start), joined.count(b" ", start, end) + 1, n.label, edits))
    return {"n_words": len(words), "base": base, "base_labels": base_labels, "labels": labels | base_labels, "spans": sorted(spans), "score": score}


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word:long,n_words:long,label:string,edits:long>>"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row a document with its counts, labels, score and spans."""
    span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column(1):
                r = scan(text.as_py())
                row = (
                    r["n_words"], len(r["base"]), min(r["base"], default=None), max(r["base"], default=None),
                    ",".join(sorted(r["base_labels"])), ",".join(sorted(r["labels"])), r["score"],
                    [dict(zip(("first_word", "n_words", "label", "edits"), s, strict=True)) for s in r["spans"]],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, _SCHEMA)
