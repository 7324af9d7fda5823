"""Quality rules by line labelling: a linear-chain conditional random field and Viterbi decoding.

Every line with a word is one position of a chain; empty lines are skipped. What
is known of a line are bins of twelve measures: its words, their length, capitals,
digits, symbols and other marks, words equal to the one before, words in repeated
windows, how it ends, whether an earlier line is equal, where it stands, and
bars. A line's score for boilerplate over content is the sum of its bins'
weights; pairs of neighbouring labels have weights too.

Only documents are labelled, not lines. The field starts with all lines of good
documents as content and all lines of bad ones as boilerplate; bad documents'
lines are then labelled anew by the field so far, at first by the bins alone,
which parts their clean lines from the others, and it is fitted again. It is fitted, on the driver, to a
bounded sample: at most TRAIN good and TRAIN bad documents of at most LINES
lines, those whose doc_ids have the smallest hashes. Decoding runs over all
lines of all documents.

A document is kept if its rules hold (at least 50 words, at most half of them in
repeated windows of three) and at least SHARE of its words stand in content.

Defined cases: a null or empty text has no words and fails the rules; without
labels of both kinds the rules alone decide; null or repeated ids are rows like
others (of a labelled id that repeats, the smallest text counts in the sample,
and the highest label); an empty table gives an empty result; extra columns pass
through `keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm.words import U, mix, part, small, sums

TRAIN, LINES, SHARE = 1000, 64, 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes of texts measured at once, unless one is longer.
GROUP = 1 << 18


def _set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


_SPACE = _set(b" \t\n\v\f\r")
_SYMBOL = _set(b"#*$%&|<>")
_CAPITAL, _SMALL, _DIGIT = _set(bytes(range(0x41, 0x5B))), _set(bytes(range(0x61, 0x7B))), _set(b"0123456789")
_BAR, _MARK = _set(b"|"), _set(b"!?:;=+~^_/\\@()[]{}")
_FIRST = ~_set(bytes(range(0x80, 0xC0)))  # the first byte of a code point

#: Upper edges of the bins of each measure.
EDGES = {
    "words": (1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5),
    "length": (2, 3, 4, 5, 6, 8, 12),
    "capitals": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.001, 0.02, 0.1, 0.3),
    "symbols": (0.001, 0.05, 0.2, 0.5, 1, 2),
    "marks": (0.001, 0.05, 0.2, 0.5, 1, 2),
    "echoes": (0.001, 0.05, 0.2, 0.5),
    "repeats": (0.001, 0.1, 0.3, 0.6, 0.9),
    "ends": (0.5, 1.5),
    "equal": (0.5,),
    "place": (0.5, 1.5, 2.5),
    "bars": (0.001, 0.1, 0.3),
}
_FROM = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
BINS = int(_FROM[-1])


@dataclass
class Measured:
    """Texts and their lines that hold words: line i belongs to text `owner[i]` and begins with byte `start[i]` of it."""

    first: int
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line_words: np.ndarray
    bins: np.ndarray  # (lines, measures): indices into the weights

    def failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def groups(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, about GROUP bytes at a time; null counts as empty."""
    first, had, group = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if group and had + len(raw) > GROUP:
            yield first, group
            first, had, group = i, 0, []
        group.append(raw)
        had += len(raw)
    if group:
        yield first, group


def _share(part_: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part_ / np.maximum(whole, 1)


def measure(texts: list) -> Iterator[Measured]:
    """The measures of all texts and lines, in groups of bounded size unless one text is larger."""
    for first, group in groups(texts):
        n = len(group)
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in group])))
        inside = ~_SPACE[data]
        change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        start, end = change[::2], change[1::2]
        ptr = np.searchsorted(start, begin)
        count = np.diff(ptr)
        owner = np.repeat(np.arange(n), count)
        prefix = sums(data)
        h = part(prefix, start, end) if len(start) else np.zeros(0, U)

        # words in windows of three that stand more than once in their text
        repeated = np.zeros(len(h), bool)
        at = np.flatnonzero(owner[:-2] == owner[2:]) if len(h) > 2 else np.zeros(0, np.int64)
        if len(at):
            window = mix((h[at] * U(3) + mix(h[at + 1] + U(1))) * U(0x9E3779B97F4A7C15) + mix(h[at + 2] + U(2)) + owner[at].astype(U))
            _, back, many = np.unique(window, return_inverse=True, return_counts=True)
            again = at[many[back] > 1]
            for k in range(3):
                repeated[again + k] = True
        echo = np.zeros(len(h), bool)
        echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])

        # lines, of which every one ends with a line feed
        stop = np.flatnonzero(data == 10)
        line = np.concatenate(([0], stop[:-1] + 1))
        line_owner = np.searchsorted(begin, line, "right") - 1
        number = np.arange(len(line)) - np.searchsorted(line, begin[:-1])[line_owner]
        word_at = np.searchsorted(start, np.append(line, len(data)))
        own = np.flatnonzero(np.diff(word_at))
        line, stop, line_owner, number = line[own], stop[own], line_owner[own], number[own]
        words_in = np.diff(word_at)[own]
        same = np.ones(len(own), bool)
        if len(own):
            _, at = np.unique(mix(part(prefix, line, stop) + (stop - line).astype(U)) + line_owner.astype(U) * U(0x9E3779B97F4A7C15), return_index=True)
            same[at] = False
        del prefix

        def by_text(mask: np.ndarray, begin: np.ndarray = begin) -> np.ndarray:
            return np.add.reduceat(mask, begin[:-1], dtype=np.int64)

        def by_line(table: np.ndarray, data: np.ndarray = data, line: np.ndarray = line, stop: np.ndarray = stop) -> np.ndarray:
            hits = np.flatnonzero(table[data])
            return np.searchsorted(hits, stop) - np.searchsorted(hits, line)

        def of_words(mask: np.ndarray, word_at: np.ndarray = word_at, own: np.ndarray = own) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[word_at[own + 1]] - total[word_at[own]]

        chars = of_words(np.diff(np.concatenate(([0], np.cumsum(_FIRST[data] & inside)))[np.stack((start, end), 1)], axis=1)[:, 0]) if len(start) else np.zeros(0, np.int64)
        capitals, digits = by_line(_CAPITAL), by_line(_DIGIT)
        closing = data[end[word_at[own + 1] - 1] - 1] if len(own) else np.zeros(0, np.uint8)
        head = np.ones(len(own), bool)
        head[1:] = line_owner[1:] != line_owner[:-1]
        tail = np.append(head[1:], True)[: len(own)]
        values = {
            "words": words_in,
            "length": _share(chars, words_in),
            "capitals": _share(capitals, capitals + by_line(_SMALL)),
            "digits": _share(digits, chars),
            "symbols": _share(by_line(_SYMBOL), words_in),
            "marks": _share(by_line(_MARK), words_in),
            "echoes": _share(of_words(echo), words_in),
            "repeats": _share(of_words(repeated), words_in),
            "ends": np.where(closing == ord("."), 0, np.where(_MARK[closing] | _SYMBOL[closing], 2, 1)),
            "equal": same,
            "place": np.where(head, np.where(tail, 3, 0), np.where(tail, 2, 1)),
            "bars": _share(by_line(_BAR), words_in),
        }
        bins = np.stack([f + np.searchsorted(EDGES[k], v.astype(float)) for (k, v), f in zip(values.items(), _FROM, strict=False)], 1)
        yield Measured(
            first, count, by_text(_FIRST[data] & inside), by_text(_SYMBOL[data]), np.bincount(line_owner[same], minlength=n), np.bincount(owner[repeated], minlength=n),
            line_owner, number, line - begin[line_owner], stop - begin[line_owner], words_in, bins,
        )


@dataclass
class Field:
    """Weights of the bins, for boilerplate over content, and of label pairs (before, after); 0 is content, 1 boilerplate."""

    weights: np.ndarray
    pairs: np.ndarray

    def mark(self, bins: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The likeliest labelling of each text's lines, whether boilerplate; content where both are as likely."""
        score = self.weights[bins].sum(1).tolist()
        head = np.ones(len(owner), bool)
        head[1:] = owner[1:] != owner[:-1]
        (cc, cb), (bc, bb) = self.pairs.tolist()
        back, ends = [], []
        content = boilerplate = 0.0
        for s, new in zip(score, head.tolist(), strict=True):
            if new:
                ends.append(boilerplate > content)
                back.append((0, 0))
                content, boilerplate = 0.0, s
            else:
                to_c, to_b = boilerplate + bc > content + cc, boilerplate + bb > content + cb
                back.append((to_c, to_b))
                content, boilerplate = max(content + cc, boilerplate + bc), s + max(content + cb, boilerplate + bb)
        ends.append(boilerplate > content)
        out = np.zeros(len(score), bool)
        label = ends.pop()
        for i in range(len(score) - 1, -1, -1):
            out[i] = label
            label = ends.pop() if head[i] else back[i][label]
        return out


def fit(bins: np.ndarray, owner: np.ndarray, label: np.ndarray, start: Field | None = None, steps: int = 100, rate: float = 0.1, keep: float = 1.0, chain: bool = True) -> Field:
    """The field of the largest penalised likelihood of these lines' labels, by gradient steps of adaptive size.

    Without `chain` label pairs weigh nothing.
    """
    n = int(owner.max(initial=-1)) + 1
    size = np.bincount(owner, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(n)  # long chains first, so that those of at least t lines are the first ones
    row, column = rank[owner], np.arange(len(owner)) - np.concatenate(([0], np.cumsum(size)))[owner]
    width = int(size.max(initial=0))
    active = [int((size > t).sum()) for t in range(width)]
    truth = np.zeros((n, width), np.int64)
    truth[row, column] = label
    told = np.zeros((2, 2))
    for t in range(1, width):
        np.add.at(told, (truth[: active[t], t - 1], truth[: active[t], t]), 1)
    theta = np.concatenate((start.weights, start.pairs.reshape(-1))) if start else np.zeros(BINS + 4)
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, steps + 1):
        pairs = theta[BINS:].reshape(2, 2)
        emit = np.zeros((n, width, 2))
        emit[row, column, 1] = theta[:BINS][bins].sum(1)
        ahead, behind = emit.copy(), np.zeros((n, width, 2))
        for t in range(1, width):
            a = ahead[: active[t], t - 1]
            ahead[: active[t], t] += np.logaddexp(a[:, :1] + pairs[0], a[:, 1:] + pairs[1])
        for t in range(width - 1, 0, -1):
            b = behind[: active[t], t] + emit[: active[t], t]
            behind[: active[t], t - 1] = np.logaddexp(b[:, :1] + pairs[:, 0], b[:, 1:] + pairs[:, 1])
        total = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1]) if width else np.zeros(n)
        likely = np.exp(ahead[row, column, 1] + behind[row, column, 1] - total[row])
        met = np.zeros((2, 2))
        for t in range(1, width):
            m = active[t]
            joint = ahead[:m, t - 1, :, None] + pairs + (emit[:m, t] + behind[:m, t])[:, None, :] - total[:m, None, None]
            met += np.exp(joint).sum(0)
        slope = np.concatenate((np.bincount(bins.reshape(-1), np.repeat(label - likely, bins.shape[1]), BINS), (told - met).reshape(-1) * chain)) - keep * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Field(theta[:BINS], theta[BINS:].reshape(2, 2))


def learn(bins: np.ndarray, owner: np.ndarray, bad: np.ndarray, rounds: int = 2) -> Field:
    """A field from lines of which only the document's label is known: bad of each document."""
    label = bad[owner].astype(np.int64)
    field = fit(bins, owner, label, chain=False)  # labels that are all alike in a document would tie neighbours together
    for _ in range(rounds):
        marked = field.mark(bins, owner)
        some = np.bincount(owner, marked, len(bad)) > 0  # a bad document has boilerplate somewhere
        label = np.where(bad[owner], np.where(some[owner], marked, 1), 0).astype(np.int64)
        field = fit(bins, owner, label, field, 60)
    return field


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN, lines: int = LINES) -> Field | None:
    """The field fitted to a sample of labelled documents; None without good or without bad ones."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    lot = F.xxhash64(F.lit("crf"), "doc_id")
    chosen = known.where("quality = 1").orderBy(lot, "doc_id").limit(most).union(known.where("quality <> 1").orderBy(lot, "doc_id").limit(most))
    chosen = scratch.keep(chosen, "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for found in measure(batch.column(2).to_pylist()):
                few = np.flatnonzero(np.bincount(found.owner, minlength=len(found.n_words)) <= lines)
                here = np.isin(found.owner, few)
                at = pa.array(found.first + found.owner[here])
                bins = pa.ListArray.from_arrays(pa.array(np.arange(here.sum() + 1) * len(EDGES), pa.int32()), pa.array(found.bins[here].reshape(-1), pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found.number[here]), bins], ["doc_id", "quality", "line", "bins"])

    got = texts.mapInArrow(rows, "doc_id long, quality int, line long, bins array<short>").toArrow().sort_by([("doc_id", "ascending"), ("line", "ascending")])
    doc, owner = np.unique(got.column(0).to_numpy(), return_inverse=True)
    bad = np.zeros(len(doc), bool)
    bad[owner] = got.column(1).to_numpy() != 1
    if not bad.any() or bad.all():
        return None
    return learn(got.column(3).combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, len(EDGES)), owner, bad)


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """Every line with a word: doc_id, line (from 0), start and end in bytes, n_words, boilerplate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for found in measure(batch.column(1).to_pylist()):
                marked = field.mark(found.bins, found.owner)
                ids = batch.column(0).take(pa.array(found.first + found.owner))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (found.number, found.start, found.end, found.line_words, marked))], ["doc_id", "line", "start", "end", "n_words", "boilerplate"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(rows, "doc_id long, line long, start long, end long, n_words long, boilerplate boolean")


_COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()


def judge(docs: DataFrame, field: Field | None, share: float = SHARE) -> DataFrame:
    """_row (all columns), the rules' counts, base_failed, kept, n_lines, n_content_lines and content_share of each document."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for found in measure(batch.column(1).to_pylist()):
                n, failed = len(found.n_words), found.failed()
                content = ~field.mark(found.bins, found.owner) if field else np.ones(len(found.owner), bool)
                words = np.bincount(found.owner, content * found.line_words, n)
                part_ = np.where(found.n_words > 0, words / np.maximum(found.n_words, 1), 0.0)
                columns = [getattr(found, c) for c in _COLUMNS] + [failed, ~failed & (part_ >= share)]
                columns += [np.bincount(found.owner, minlength=n), np.bincount(found.owner[content], minlength=n), part_]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(found.first, n), *map(pa.array, columns)], names)

    names = ["_row", *_COLUMNS, "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]
    kinds = [*["long"] * 5, "boolean", "boolean", "long", "long", "double"]
    schema = rows.where("false").select("_row").schema
    for name, kind in zip(names[1:], kinds, strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rules' counts, base_failed, kept, n_lines, n_content_lines, content_share of every document."""
    found = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return found.select("_row.doc_id", *[c for c in found.columns if c != "_row"])


def keep(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that stay, with all their columns."""
    return judge(docs, train(docs, labels), share).where("kept").select("_row.*")
