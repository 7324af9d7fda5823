import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from snapgraph.llm import gif

PALETTE = bytes(v for i in range(256) for v in (i, 255 - i, i // 2))


@pytest.mark.parametrize("n", [0, 1, 2, 576, 5000, 40_000])
def test_streams_round_trip(n):
    random.seed(n)
    for data in (os.urandom(n), b"a" * n, bytes(random.choices(b"ab", k=n)), (b"the quick " * (n // 10 + 1))[:n]):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
        small = bytes(b & 3 for b in data)
        assert gif.lzw_decode(gif.lzw_encode(small, 2), 2) == small


def test_deferred_clear():
    """A stream that never clears keeps a full dictionary at twelve bits."""
    random.seed(1)
    data = os.urandom(9000)
    table, width, codes, bits = {bytes([i]): i for i in range(256)}, 9, [], []
    codes.append((256, 9))
    word, j = b"", 0
    for b in data + b"\0":
        if word + bytes([b]) in table and len(codes) - 1 + 1 <= 10**9:
            word += bytes([b])
            continue
        codes.append((table[word], min(12, max(9, (257 + j).bit_length()))))
        if len(table) + 2 < 4096:
            table[word + bytes([b])] = len(table) + 2
        word, j = bytes([b]), j + 1
    codes.append((257, 12))
    for code, width in codes:
        bits += [code >> k & 1 for k in range(width)]
    assert gif.lzw_decode(np.packbits(bits, bitorder="little").tobytes(), 8) == data


def image(h, w, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)


def test_frames_and_palette():
    images = [image(5, 7, 1), image(5, 7, 2)]
    frames = list(gif.decode(gif.encode(images, PALETTE, delay_ms=40)))
    assert [f.delay_ms for f in frames] == [40, 40]
    for f, im in zip(frames, images, strict=True):
        assert (f.pixels[..., 0] == im).all() and (f.pixels[..., 1] == 255 - im).all() and (f.pixels[..., 3] == 255).all()
        assert sum(gif.histogram(f.pixels)) == 35


def block(im, left, top, disposal, key=None, interlace=False):
    h, w = im.shape
    rows = [r for s, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, step)] if interlace else range(h)
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (key is not None), 5, 0, key or 0, 0])
    place = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([0x40 if interlace else 0])
    return control + place + b"\x08" + gif._blocks(gif.lzw_encode(im[list(rows)].tobytes()))


def test_disposal_transparency_and_interlacing():
    base, part = image(10, 10, 3), image(4, 4, 4)
    head = b"GIF89a" + bytes([10, 0, 10, 0, 0xF7, 0, 0]) + PALETTE
    key = int(part[0, 0])
    media = head + block(base, 0, 0, 1, interlace=True) + block(part, 3, 3, 3, key) + block(part, 0, 0, 2) + block(part, 6, 6, 0) + b"\x3b"
    one, two, three, four = gif.decode(media)
    assert (one.pixels[..., 0] == base).all()
    want = base.copy()
    seen = part != key
    want[3:7, 3:7][seen] = part[seen]
    assert (two.pixels[..., 0] == want).all()
    want = base.copy()  # the second frame was undone
    want[:4, :4] = part
    assert (three.pixels[..., 0] == want).all()
    assert (four.pixels[:4, :4, 3] == 0).all() and (four.pixels[6:, 6:, 0] == part).all()  # the third one cleared


def test_damage():
    good = gif.encode([image(20, 20, 5)], PALETTE)
    assert len(list(gif.decode(good[:-40]))) <= 1
    with pytest.raises(ValueError):
        list(gif.decode(b"no gif at all"))


def test_frame_rows(spark):
    media = [(1, gif.encode([image(3, 3, 6), image(3, 3, 7)], PALETTE, 50), "x"), (2, None, "x"), (3, b"junk", "x"), (4, b"", "x")]
    got = gif.frames(spark.createDataFrame([(k, None if m is None else bytearray(m), x) for k, m, x in media], "media_id long, media binary, frame string")).collect()
    assert [(r.media_id, r.frame, r.start_ms, r.width, r.error) for r in sorted(got, key=lambda r: (r.media_id, r.frame or 0))] == [(1, 0, 0, 3, None), (1, 1, 50, 3, None), (3, None, None, None, "not a GIF")]


def test_stored_texts(spark):
    texts = ["", None, "é" * 300, "x" * 576, "long " * 9000, "é" * 300]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, media_bytes int")
    got = {r.doc_id: r for r in gif.store_texts(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2].asDict() | {"doc_id": 5} == got[5].asDict()
    assert gif.store_texts(df.limit(0)).count() == 0


def test_hostile_headers_and_many_frames(spark):
    """Headers that ask for gigabytes give an error row; frames before them stay; frames are packed."""
    import struct

    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    image = np.zeros((2, 3), np.uint8)
    wide = gif.encode([image], b"", 50)[:-1] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x44\x01\x00\x3b"
    many = gif.encode([image + i for i in range(150)], b"")
    rows = [(1, huge), (2, wide), (3, many), (None, many), (4, None), (5, b""), (6, b"none")]
    got = gif.frames(spark.createDataFrame([(*r, "x") for r in rows], "media_id long, media binary, frame string")).collect()
    assert sorted((r.media_id, r.frame is None, (r.error or "")[:8]) for r in got if r.media_id in (1, 2, 6)) == [(1, True, "a canvas"), (2, False, ""), (2, True, "an image"), (6, True, "not a GI")]
    for key in (3, None):
        own = sorted((r.frame, r.start_ms) for r in got if r.media_id == key)
        assert own == [(i, 100 * i) for i in range(150)]
    assert gif.frames(spark.createDataFrame([], "media_id long, media binary")).count() == 0
