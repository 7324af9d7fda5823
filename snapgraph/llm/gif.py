"""GIF images as columns: LZW code streams, palettes, disposal, transparency, timed frames.

`decode` reads any GIF87a or GIF89a file (global and local palettes, interlacing,
sub-rectangles, all disposal methods, transparency) into composed RGBA frames
with their times and colour histograms; `encode` writes frames of palette
indexes. `frames` is the DataFrame form, one row a frame, and `store_texts`
keeps byte payloads losslessly as samples of a grey palette.

Defined cases: null or empty media give no frames; media that end early give
the frames and rows decoded so far, the rest transparent; media that are no GIF,
and those whose canvas or image has more than MOST_PIXELS pixels, as their
headers say, give an error text behind the frames decoded before. A null text is
stored as an empty one, a null key stays null, repeated rows give equal rows, an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.words import small

_LONGEST = 4096
#: The largest canvas or image that is decoded, 256 MB of RGBA; a header of ten bytes may ask for 17 GB.
MOST_PIXELS = 1 << 26
#: Bytes of frames in an Arrow batch, about.
BATCH = 16 << 20
#: Fixed values of the format: start and step of the passes of an interlaced image.
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


@dataclass
class Frame:
    index: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    pixels: np.ndarray  # the composed canvas, height x width x RGBA
    drawn: np.ndarray  # the part of the canvas that this frame covers


def _schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and first bit of the j-th code after a clear code, for minimum code size `size`."""
    clear = 1 << size
    j = np.arange(2 * _LONGEST)
    width = np.maximum(size + 1, np.minimum(12, np.ceil(np.log2(clear + 2 + j)).astype(np.int64)))
    return width, np.concatenate(([0], np.cumsum(width)))


_schedules = {n: _schedule(n) for n in range(1, 12)}


def lzw_decode(data: bytes, size: int, most: int | None = None) -> bytes:
    """The samples of an LZW stream with minimum code size `size`; `most` bounds how many are wanted.

    Every phrase of the dictionary is a stretch of what has been put out before:
    that of entry k begins where the k-th code's output began and is one longer.
    """
    clear, stop = 1 << size, (1 << size) + 1
    first = clear + 2
    entries = _LONGEST - first
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out = 8 * len(data), 0, bytearray()
    width, begin = _schedules[size]
    offsets: list[int] = []
    lengths: list[int] = []
    done = False
    while not done and at < bits:
        j = len(offsets)
        if j < len(width) // 2:
            n = int(np.searchsorted(begin, bits - at + begin[j], "right")) - 1 - j
            n = min(n, _LONGEST, len(width) - j)
            where, each = at + begin[j : j + n] - begin[j], width[j : j + n]
        else:  # the dictionary has long been full
            n = min((bits - at) // 12, _LONGEST)
            where, each = at + 12 * np.arange(n), np.full(n, 12)
        if n <= 0:
            break
        byte = where >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7).astype(np.uint32) & ((1 << each) - 1).astype(np.uint32)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        again = False
        if len(ends):
            n = int(ends[0])
            again, done = codes[n] == clear, codes[n] == stop
            at = int(where[n] + each[n])
        else:
            at = int(where[-1] + each[-1])
        pos = len(out)
        for c in codes[:n].tolist():
            if c < clear:
                out.append(c)
                length = 1
            else:
                k = c - first
                if k >= min(len(offsets), entries):
                    return bytes(out[:most])  # no such entry: the stream is damaged
                s = offsets[k]
                length = lengths[k] + 1
                if s + length > pos:
                    out += out[s:pos]
                    out.append(out[s])
                else:
                    out += out[s : s + length]
            offsets.append(pos)
            lengths.append(length)
            pos += length
        if again:
            offsets, lengths = [], []
        if most is not None and pos >= most:
            break
    return bytes(out if most is None else out[:most])


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """An LZW stream of samples below 2**size; the dictionary starts anew when it is full."""
    clear = 1 << size
    width, _ = _schedules[size]
    runs: list[np.ndarray] = []
    widths: list[np.ndarray] = []
    codes: list[int] = []
    now = size + 1  # the width of the clear code

    def flush(last: int) -> None:
        nonlocal now, codes
        runs.append(np.array([*codes, last], np.uint32))
        widths.append(width[: len(codes) + 1])
        now, codes = int(width[len(codes)]), []

    runs.append(np.array([clear], np.uint32))
    widths.append(np.array([now]))
    if samples:
        # codes are held eight bits to the left, so that the key of code and sample is their union
        table: dict[int, int] = {}
        get, put, following, full = table.get, codes.append, clear + 2 << 8, _LONGEST << 8
        current = samples[0] << 8
        for b in samples[1:]:
            key = current | b
            current = get(key)
            if current is None:
                put(key >> 8)
                current = b << 8
                table[key] = following
                following += 256
                if following == full:
                    flush(clear)
                    table = {}
                    get, put, following = table.get, codes.append, clear + 2 << 8
        put(current >> 8)
    flush(clear + 1)
    code, each = np.concatenate(runs), np.concatenate(widths)
    end = np.cumsum(each)
    spread = np.zeros(int(end[-1]), np.uint8)
    start = end - each
    for bit in range(12):
        wide = each > bit
        spread[start[wide] + bit] = code[wide] >> np.uint32(bit) & 1
    return np.packbits(spread, bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(part),)) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(images: list[np.ndarray], palette: bytes, delay_ms: int = 100, disposal: int = 1) -> bytes:
    """A GIF89a of index images, each drawn at the upper left; the first sets the canvas, 256 palette colours."""
    height, width = images[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.ljust(768, b"\0")]
    for image in images:
        h, w = image.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + _blocks(lzw_encode(image.tobytes())))
    return b"".join([*out, b"\x3b"])


def decode(media: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF, in order. ValueError if it doesn't begin as one or is too large."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at, size = 13, len(media)

    def colours(packed: int) -> np.ndarray | None:
        nonlocal at
        if not packed & 0x80:
            return None
        n = 2 << (packed & 7)
        table = np.zeros((256, 3), np.uint8)
        got = np.frombuffer(media[at : at + 3 * n], np.uint8)
        table.reshape(-1)[: len(got)] = got
        at += 3 * n
        return table

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < size and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height} pixels is too large")
    shared = colours(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    index, control = 0, (0, 0, None)
    while at < size:
        kind = media[at]
        at += 1
        if kind == 0x21 and at < size:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, key = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay * 10, key if packed & 1 else None)
        elif kind == 0x2C and at + 9 <= size:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at)
            at += 9
            if w * h > MOST_PIXELS:
                raise ValueError(f"an image of {w} x {h} pixels is too large")
            palette = colours(packed)
            palette = shared if palette is None else palette
            if palette is None:
                palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
            if at >= size or not 1 <= media[at] <= 11:
                return
            least = media[at]
            at += 1
            got = np.frombuffer(lzw_decode(blocks(), least, w * h), np.uint8)
            drawn = np.zeros(w * h, bool)
            drawn[: len(got)] = True
            samples = np.zeros(w * h, np.uint8)
            samples[: len(got)] = got
            samples, drawn = samples.reshape(h, w), drawn.reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(s, h, step) for s, step in _PASSES])
                straight, was = np.empty_like(samples), np.empty_like(drawn)
                straight[rows], was[rows] = samples, drawn
                samples, drawn = straight, was
            disposal, delay, key = control
            if key is not None:
                drawn = drawn & (samples != key)
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            inside = drawn[: part.shape[0], : part.shape[1]]
            rgb = palette[samples[: part.shape[0], : part.shape[1]]]
            part[..., :3][inside] = rgb[inside]
            part[..., 3][inside] = 255
            yield Frame(index, delay, disposal, left, top, canvas.copy(), part.copy())
            if disposal == 2:
                part[...] = 0
            elif disposal == 3:
                canvas = before
            index, control = index + 1, (0, 0, None)
        elif kind == 0x3B:
            return


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of the opaque pixels in 4 x 4 x 4 colour cells, red slowest."""
    seen = rgba[rgba[..., 3] > 0].astype(np.int64) >> 6
    return np.bincount(seen[:, 0] * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64).tolist()


_FRAMES = "key long, frame int, start_ms long, delay_ms int, disposal int, width int, height int, rgba binary, histogram array<long>, error string"


def frames(media: DataFrame, key: str = "media_id", data: str = "media") -> DataFrame:
    """One row a composed frame of every GIF: key, frame, start_ms, delay_ms, disposal, size, RGBA, histogram; or an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FRAMES.split(", ")]
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in small(batches):
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = 0
                try:
                    for f in decode(m.as_py()) if m.as_py() else ():
                        h, w, _ = f.pixels.shape
                        held.append((k, f.index, start, f.delay_ms, f.disposal, w, h, f.pixels.tobytes(), histogram(f.pixels), None))
                        start += f.delay_ms
                        if len(held) >= 64 or sum(len(row[7] or b"") for row in held) >= BATCH:
                            yield packed()
                except ValueError as e:
                    held.append((k, None, None, None, None, None, None, None, None, str(e)))
            if held:
                yield packed()

    return media.select(F.col(f"`{key}`").cast("long"), F.col(f"`{data}`").cast("binary")).mapInArrow(rows, _FRAMES).withColumnRenamed("key", key)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

#: Samples in a row of a stored payload, and rows in a frame at most.
LINE, ROWS = 576, 64
_GREY = bytes(v for v in range(256) for _ in range(3))


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 576 bytes as a GIF with a grey palette, frames of up to 64 lines."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    return encode([lines[i : i + ROWS] for i in range(0, len(lines), ROWS)], _GREY)


def load(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload of a stored GIF, its grey levels' counts in 16 cells, and the number of frames."""
    parts, counts, n = [], np.zeros(16, np.int64), 0
    for f in decode(media):
        grey = np.ascontiguousarray(f.drawn[..., 0])
        counts += np.bincount(grey.reshape(-1) >> 4, minlength=16)
        parts.append(grey.tobytes())
        n += 1
    return b"".join(parts), counts, n


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF, read back and described; one row a document.

    feature: the number of frames and the 16-cell grey histogram of what was read back.
    """
    names = [x.split()[0] for x in _STORED.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                pad = -len(raw) % LINE if raw else LINE
                media = store(raw + b"\xff" * pad)
                payload, counts, n = load(media)
                out.append(
                    (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{n}|" + ",".join(map(str, counts.tolist())))
                )
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, _STORED)
