"""Byte-level BPE as a tree reduction over a monoid of encoded strings.

A string is halved until its parts are short; a part's tokens are joined with
its neighbour's by re-encoding a window around the boundary, which grows until
the tokens outside are stable. Two neighbouring tokens are stable if encoding
their concatenated bytes gives the two again, and a sequence whose neighbours
are all stable is the string's encoding, so the join is exact and associative.
Decoding concatenates bytes up a tree.

The vocabulary is a file of base64 tokens and ranks; each match of the pattern
is encoded separately. Defined cases: a null text is empty and has no tokens;
rows are independent, repeated ones get equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.llm.words import small

#: Bytes in a leaf of the tree; pieces remembered by a worker; tokens joined at once by a leaf of the decoder.
LEAF, REMEMBERED, DECODED = 24, 1 << 18, 4096
#: The rank of two neighbours that don't merge.
NONE = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.stable = lru_cache(1 << 18)(self._stable)
        self._seen: dict[str, str] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a short string: of all neighbours, those of the lowest joint rank merge first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        scores = [rank(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
        while scores and (least := min(scores)) < NONE:
            i = scores.index(least)
            both = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], scores[i]
            if i < len(scores):
                scores[i] = rank(both + parts[i + 1], NONE)
            if i:
                scores[i - 1] = rank(parts[i - 1] + both, NONE)
        return parts

    def _stable(self, left: bytes, right: bytes) -> bool:
        return self.merge(left + right) == [left, right]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of the concatenation of two encoded strings."""
        if not left or not right:
            return left or right
        a, b = 1, 1
        if self.stable(left[-1], right[0]):
            return left + right
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.tree(b"".join(left[-a:] + right[:b])) if a + b < len(left) + len(right) else self.merge(b"".join(left + right))
            fits = a == len(left) or self.stable(left[-a - 1], window[0])
            holds = b == len(right) or self.stable(window[-1], right[b])
            if fits and holds:
                return left[: len(left) - a] + window + right[b:]
            a, b = a * (1 if fits else 2), b * (1 if holds else 2)

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else [self.ranks[t] for t in self.tree(data)]

    def encode_text(self, text: str) -> str:
        """The ids of a text, decimal, joined by one space."""
        seen = self._seen
        out = []
        for piece in self.split.findall(text):
            ids = seen.get(piece)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = " ".join(map(str, self.encode_piece(piece)))
                if len(piece) <= 64:
                    seen[piece] = ids
            out.append(ids)
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_text(text).split()))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, read on the driver from its own disk; a vocabulary has a fixed size, below 1 MB here."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = True, ids: bool = True) -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, and ids array<int> or digests of ids and decoded bytes."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(docs.sparkSession, path))
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in small(batches):
            counts, lists, hashes, decoded = [], [], [], []
            for text in batch.column(1):
                joined = codec.encode_text(text.as_py() or "")
                own = np.array(joined.split(), np.int32) if joined else np.zeros(0, np.int32)
                counts.append(len(own))
                if ids:
                    lists.append(own)
                if digests:
                    hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(own.tolist())).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if ids:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))))
            if digests:
                columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, bytes that are no UTF-8 give U+FFFD."""
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary(encoded.sparkSession, path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, "")
        for batch in small(batches):
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(rows, "doc_id long, text string")
