"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

From labelled training documents, elements are mined that stand in toxic
documents more often than chance allows: whole words and pieces at words'
beginnings and ends, so that families of words are met too, each as standing in
a text at all, or as often as so many words in a hundred. Elements of a kind are dealt
over lexicons by their hashes, so that lexicons err independently; a lexicon
votes for toxic where the text holds one of its elements. A generative label
model, fitted to the votes alone, estimates each voter's accuracy and which
voters depend on each other beyond what the label explains; the given labels
only say which side is toxic. A logistic classifier over the elements is trained
on the model's posterior labels and scores every text.

Up to TRAIN labelled documents are used, those of the smallest hashes of doc_id.
Defined cases: a null text is empty; an empty text, or one without elements,
gets the score of no evidence, below the threshold; without labelled toxic or
without labelled clean documents all get that score; repeated rows get equal
results; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lsh
from snapgraph.llm.words import U, Words, mix, part, shingles, small, sums, words

#: Labelled documents that are used at most, elements of the classifier at most, and lexicons of each kind.
TRAIN, ELEMENTS, LEXICONS = 20_000, 4096, 4
#: Kinds of elements: whole words, and the first or last so many bytes of longer words.
KINDS = (("word", 0), ("begin", 4), ("begin", 5), ("begin", 6), ("begin", 7), ("end", 5), ("end", 6))
#: Each element is also told apart by how often it stands in a hundred words, at least, and twice or more; at first by standing there at all.
LEVELS = (0.0, 0.5, 1.0, 2.0)
#: The share of an element's texts that are toxic, at least; how strongly weights are held to what an element says alone.
PRECISION, HOLD = 0.6, 0.1
THRESHOLD = 0.3
#: The score of a document without evidence.
NONE = 0.01
_FILTER = 1 << 16


def elements(found: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, hash, word) for each kind of element of each word of a group of texts."""
    prefix = sums(found.data)
    for kind, (side, size) in enumerate(KINDS):
        if side == "word":
            yield kind, mix(found.hashes + U(kind)), np.arange(len(found.hashes))
            continue
        at = np.flatnonzero(found.end - found.start > size)
        if side == "begin":
            h = part(prefix, found.start[at], found.start[at] + size)
        else:
            h = part(prefix, found.end[at] - size, found.end[at])
        yield kind, mix(h + U(kind + 1)), at


def _distinct(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's distinct elements, their kinds and counts, and three fingerprints that near copies share."""
    for found in words(texts):
        n = len(found.ptr) - 1
        owner = np.repeat(np.arange(n), np.diff(found.ptr))
        parts = [(kind, h, owner[at]) for kind, h, at in elements(found)]
        kinds = np.concatenate([np.full(len(h), k, np.int8) for k, h, _ in parts])
        hashes, owners = np.concatenate([h for _, h, _ in parts]), np.concatenate([o for _, _, o in parts])
        order = np.lexsort((hashes, owners))
        hashes, owners, kinds = hashes[order], owners[order], kinds[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        hashes, owners, kinds = hashes[new], owners[new], kinds[new]
        ptr = np.searchsorted(owners, np.arange(n + 1))
        runs, whose = shingles(found, 5)
        for i in range(n):
            own = runs[whose == i] if n < 64 else runs[np.searchsorted(whose, i) : np.searchsorted(whose, i + 1)]
            marks = np.array([own.min(), mix(own + U(1)).min(), mix(own + U(2)).min()]) if len(own) else np.zeros(3, U)
            some = slice(ptr[i], ptr[i + 1])
            yield hashes[some], kinds[some], count[some], marks


def _reached(counts: np.ndarray, n_words: np.ndarray | int) -> np.ndarray:
    """The highest level of elements that stand so often in texts of so many words."""
    rate = 100.0 * counts / np.maximum(n_words, 1)
    return np.where(counts > 1, np.searchsorted(LEVELS, rate, "right") - 1, 0)


def _levels(h: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, element, kind, level) of a text's elements, each once for every level that it reaches."""
    n_words = int(counts[kinds == 0].astype(np.int64).sum())
    top = _reached(counts.astype(np.int64), n_words)
    reached = [np.flatnonzero(top >= k) for k in range(len(LEVELS))]
    level = np.repeat(np.arange(len(LEVELS)), list(map(len, reached)))
    at = np.concatenate(reached)
    return mix(h[at] + level.astype(U) * U(0xA24BAED4963EE407)), h[at], kinds[at], level


def _tally(ids: list[np.ndarray], rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, how often each, and one value of the rest for each."""
    every = np.concatenate([np.zeros(0, U), *ids])
    distinct, at, n = np.unique(every, return_index=True, return_counts=True)
    return distinct, n, np.concatenate([np.zeros((0, 3), U), *rest])[at]


def training(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """(doc_id, text, toxic), written: up to `train` labelled documents that are not held out, of near copies one."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train), "train", fewer=True)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    chosen = scratch.keep(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "chosen")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            marks = np.array([m for *_, m in _distinct(batch.column(1).to_pylist())]).reshape(batch.num_rows, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(marks[:, k]) for k in range(3))], ["doc_id", "a", "b", "c"])

    met: set[int] = set()
    kept = []
    for doc_id, *marks in zip(*(c.to_pylist() for c in chosen.select("doc_id", "text").mapInArrow(mark, "doc_id long, a long, b long, c long").orderBy("doc_id").toArrow().columns), strict=True):
        new = set(marks) - {0}
        if not new & met:
            met |= new
            kept.append((doc_id,))
    one = docs.sparkSession.createDataFrame(kept, "doc_id long")  # at most `train` ids
    return scratch.keep(chosen.join(F.broadcast(one), "doc_id"), "training")


_COUNTED = "id long, element long, kind int, level int, n long"


def _count(rows: DataFrame, among: np.ndarray | None) -> DataFrame:
    """(id, element, kind, level, n): texts that hold each element, of those in `among` if given."""
    sent = rows.sparkSession.sparkContext.broadcast(among)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            ids, rest = [], []
            for h, kinds, counts, _ in _distinct(batch.column(0).to_pylist()):
                i, e, k, level = _levels(h, kinds, counts)
                if sent.value is not None:
                    some = sent.value[np.minimum(np.searchsorted(sent.value, i), len(sent.value) - 1)] == i
                    i, e, k, level = i[some], e[some], k[some], level[some]
                ids.append(i)
                rest.append(np.stack((e, k.astype(U), level.astype(U)), 1))
            distinct, n, one = _tally(ids, rest)
            columns = (distinct.view(np.int64), one[:, 0].view(np.int64), one[:, 1].astype(np.int32), one[:, 2].astype(np.int32), n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["id", "element", "kind", "level", "n"])

    found = rows.select("text").mapInArrow(count, _COUNTED)
    return found.groupBy("id").agg(F.min("element").alias("element"), F.min("kind").alias("kind"), F.min("level").alias("level"), F.sum("n").alias("n"))


def mine(train: DataFrame, total: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, element, kind, level), sorted by id, of what stands in toxic documents beyond chance, by a likelihood-ratio test."""
    seen = _count(train.where("toxic = 1"), None).where("n >= 3").toArrow()  # of a bounded number of documents
    ids = seen.column("id").to_numpy().view(U)
    order = np.argsort(ids)
    ids, n1 = ids[order], seen.column("n").to_numpy()[order].astype(float)
    element, kind, level = (seen.column(c).to_numpy()[order] for c in ("element", "kind", "level"))
    if not len(ids):
        return ids, element.view(U), kind, level
    every = _count(train, ids).select("id", "n").toArrow()
    n = np.zeros(len(ids))
    n[np.searchsorted(ids, every.column("id").to_numpy().view(U))] = every.column("n").to_numpy()
    p, rest = base / total, np.maximum(total - n, 1e-9)

    def term(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        share = np.clip(k / np.maximum(m, 1e-9), 1e-12, 1 - 1e-12)
        return k * np.log(share) + (m - k) * np.log1p(-share)

    gain = 2 * (term(n1, n) + term(base - n1, rest) - (base * np.log(p) + (total - base) * np.log1p(-p)))
    good = (n1 / np.maximum(n, 1) > max(PRECISION, 3 * p)) & (gain > 2 * np.log(max(2, len(ids))) + 4)
    best = np.sort(np.argsort(-np.where(good, gain, -1), kind="stable")[: min(ELEMENTS, int(good.sum()))])
    return ids[best], element[best].view(U), kind[best], level[best]


def hits(train: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place) of each chosen element in each training document, and the documents' labels."""
    sent = train.sparkSession.sparkContext.broadcast(ids)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lists = []
            for h, kinds, counts, _ in _distinct(batch.column(2).to_pylist()):
                i = _levels(h, kinds, counts)[0]
                place = np.minimum(np.searchsorted(sent.value, i), len(sent.value) - 1)
                lists.append(place[sent.value[place] == i].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "toxic", "places"])

    rows = train.select("doc_id", "toxic", "text").mapInArrow(find, "doc_id long, toxic int, places array<int>").orderBy("doc_id").toArrow()
    lists = rows.column("places").to_pylist()
    return np.repeat(np.arange(len(lists)), list(map(len, lists))), np.array([x for y in lists for x in y], np.int64), rows.column("toxic").to_numpy() == 1


class LabelModel:
    """A latent label, and votes given it; a voter may depend on one other voter too, along a forest.

    Everything is estimated from the votes alone, by expectation maximisation
    that starts from how many voters agree; `parent` is the forest that joins
    voters by the strongest correlations which the label leaves unexplained.
    table[y, u, j] is the rate at which voter j votes where the label is y and its
    parent's vote is u (for roots alike).
    """

    def __init__(self, votes: np.ndarray, rounds: int = 60, least: float = 0.2) -> None:
        n, m = votes.shape
        self.parent = np.full(m, -1)
        gap = votes - votes.mean(0)
        spread = np.sqrt((gap**2).mean(0)) + 1e-9
        alike = np.minimum(np.abs(gap.T @ gap) / n / spread[:, None] / spread[None, :], 1)
        agree = votes @ (1 / np.maximum((alike**4).sum(1), 1))  # voters that always go together count as one
        q = np.clip(agree / (agree + 1.5), 0.02, 0.98)
        for step in range(rounds):
            self._fit(votes, q)
            if step in (0, 10, 25):
                self.parent = self._forest(votes, q, least if step else 0.9)  # before a label is found, only what goes together
                self._fit(votes, q)
            was, q = q, self.posterior(votes)
            if step > 30 and np.abs(q - was).max() < 1e-6:
                break

    def _fit(self, votes: np.ndarray, q: np.ndarray) -> None:
        n, m = votes.shape
        self.prior = (q.sum() + 1) / (n + 2)
        above = np.where(self.parent >= 0, votes[:, self.parent], 0.0)
        self.rate, self.table = np.empty((2, m)), np.empty((2, 2, m))
        for y, w in ((0, 1 - q), (1, q)):
            self.rate[y] = (w @ votes + (0.05, 1)[y]) / (w.sum() + 2)
            both, met = w @ (votes * above), w @ above
            self.table[y, 1] = (both + 2 * self.rate[y]) / (met + 2)
            self.table[y, 0] = (w @ votes - both + 2 * self.rate[y]) / (w.sum() - met + 2)
        self.table[:, :, self.parent < 0] = self.rate[:, None, self.parent < 0]
        # no voter speaks for clean
        self.rate[1], self.table[1] = np.maximum(self.rate[1], self.rate[0]), np.maximum(self.table[1], self.table[0])
        self.rate, self.table = np.clip(self.rate, 1e-4, 1 - 1e-4), np.clip(self.table, 1e-4, 1 - 1e-4)

    def _forest(self, votes: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
        """Each voter's parent, -1 for roots: a maximum spanning forest of correlations given the label."""
        gap = votes - q[:, None] * self.rate[1] - (1 - q)[:, None] * self.rate[0]
        spread = np.sqrt((gap**2).mean(0)) + 1e-9
        alike = np.abs(gap.T @ gap) / len(votes) / spread[:, None] / spread[None, :]
        np.fill_diagonal(alike, 0)
        parent, inside = np.full(len(alike), -1), np.zeros(len(alike), bool)
        best, via = np.full(len(alike), -1.0), np.full(len(alike), -1)
        for _ in range(len(alike)):  # each step takes the voter that is most like one inside
            j = int(np.argmax(np.where(inside, -2, best)))
            inside[j], parent[j] = True, via[j] if best[j] > least else -1
            nearer = alike[j] > best
            best, via = np.where(nearer, alike[j], best), np.where(nearer, j, via)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, votes[:, self.parent], 0.0) > 0
        rate = np.where(above[None], self.table[:, 1][:, None], self.table[:, 0][:, None])
        log = np.where(votes[None] > 0, np.log(rate), np.log1p(-rate)).sum(2)
        odds = np.log(self.prior / (1 - self.prior)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _ballots(row: np.ndarray, place: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """Votes, n x voters: for each kind LEXICONS lexicons with one hit, and a pattern of two or more different hits."""
    voter = kinds[place].astype(np.int64) * LEXICONS + place % LEXICONS
    votes = np.zeros((n, len(KINDS) * (LEXICONS + 1)), bool)
    votes[row, voter] = True
    for k in range(len(KINDS)):
        votes[:, len(KINDS) * LEXICONS + k] = np.bincount(row[kinds[place] == k], minlength=n) >= 2
    return votes.astype(float)


class Model:
    """Sorted elements with a weight for each level; a text's score is the logistic of bias plus the weights of all levels it reaches."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.hashes, where = np.unique(hashes, return_inverse=True)
        table = np.zeros((len(self.hashes), len(LEVELS)))
        table[where, levels] = weights
        self.weights, self.bias = table.cumsum(1), bias
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(hashes & U(_FILTER - 1)).astype(np.int64)] = True

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.hashes):
            for found in words(texts):
                owner = np.repeat(np.arange(len(found.ptr) - 1), np.diff(found.ptr))
                for _, h, at in elements(found):
                    hit = np.flatnonzero(self.maybe[(h & U(_FILTER - 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                    same = self.hashes[place] == h[hit]
                    pairs, count = np.unique(owner[at[hit[same]]] * len(self.hashes) + place[same], return_counts=True)
                    reached = _reached(count, np.diff(found.ptr)[pairs // len(self.hashes)])
                    np.add.at(out, pairs // len(self.hashes) + found.first, self.weights[pairs % len(self.hashes), reached])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(train: DataFrame) -> tuple[Model, LabelModel | None]:
    """Mine, vote, fit the label model, and train the classifier on its posterior labels."""
    nothing = Model(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0), float(np.log(NONE / (1 - NONE))))
    total, base = train.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not 0 < base < total:
        return nothing, None
    ids, bases, kinds, levels = mine(train, total, base)
    if not len(ids):
        return nothing, None
    row, place, toxic = hits(train, ids)
    n, m = len(toxic), len(ids)
    votes = _ballots(row, place, kinds, n)
    labels = LabelModel(votes)
    target = labels.posterior(votes)
    if target[toxic].mean() < target[~toxic].mean():  # the labels only say which side of the latent variable is toxic
        target = 1 - target
    # logistic regression by gradient steps with momentum, its bias that of no evidence; weights are held to what the elements
    # say alone and may not be negative: no element speaks for clean
    bias = float(np.log(NONE / (1 - NONE)))
    yes, no = np.bincount(place, target[row], m), np.bincount(place, 1 - target[row], m)
    alone = np.clip(np.log((yes + 0.5) / (no + 0.5)) - bias - 1, 0, 6)
    weights, speed = alone.copy(), np.zeros(m)
    scale = 1 / np.sqrt(np.bincount(place, minlength=m) + 1.0)
    for _ in range(400):
        margin = bias + np.bincount(row, weights[place], n)
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        speed = 0.9 * speed - 0.3 * scale * (np.bincount(place, error[row], m) + HOLD * (weights - alone))
        weights = np.maximum(weights + speed, 0)
    return Model(bases, levels, weights, bias), labels


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model, _ = fit(training(docs, labels))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent.value.score(batch.column(2).to_pylist()))], ["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = plain.mapInArrow(rows, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
