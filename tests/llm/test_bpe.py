import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from snapgraph.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(bpe.read_ranks(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc ", " \n\t", "!?-=", "thein ", "éàç日本", "0123456789", " \x1c\x85 a"])
def test_as_the_library(codec, known, alphabet):
    random.seed(alphabet)
    for n in (0, 1, 30, 200, 3000):
        for _ in range(5):
            text = "".join(random.choice(alphabet) for _ in range(n)) if n else ""
            ids = codec.encode(text)
            assert ids == known.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_join_is_exact_at_every_cut(codec):
    random.seed(4)
    for _ in range(20):
        data = bytes(random.choices(b"thein grandly", k=60))
        whole = codec.merge(data)
        for cut in range(len(data) + 1):
            assert codec.join(codec.merge(data[:cut]), codec.merge(data[cut:])) == whole


def test_documents(spark, known):
    texts = ["", None, "a" * 50_000, "Thé end. " * 500, "<|endoftext|>", "Thé end. " * 500]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = bpe.encode(df, PATH, P.PATTERN)
    for r in out.collect():
        want = known.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(out, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
