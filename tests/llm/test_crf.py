"""Line labelling: counts against a plain reading, decoding against all labellings, held-out verdicts, odd rows."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgraph.llm import crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The contract's counts, read word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = ["", None, " \n\t ", "\n\n", "a", "a\na\n a\na", "a b c a b c a b", "é ñ 漢字  x   y\x1cz\x85w", "#*$%&|<>\r\n|", "x " * 60, ("one two three " * 40 + "\n") * 3, "\x00 \x7f"]


def test_counts_are_those_of_a_plain_reading(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    at = 0
    for found in crf.measure(texts):
        got = np.stack([getattr(found, c) for c in crf._COLUMNS], 1).tolist()
        assert found.first == at
        for i, counts in enumerate(got):
            text = texts[at + i]
            assert tuple(counts) == plain(text)
            own = found.owner == i
            raw = (text or "").encode()
            lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            assert [raw[a:b] for a, b in zip(found.start[own], found.end[own], strict=True)] == lines
        at += len(got)
    assert at == len(texts)


def test_decoding_finds_the_best_of_all_labellings():
    draw = np.random.Generator(np.random.PCG64(5))
    for _ in range(30):
        field = crf.Field(draw.normal(size=crf.BINS), draw.normal(size=(2, 2)) * 2)
        sizes = draw.integers(1, 7, 3)
        owner = np.repeat(np.arange(3), sizes)
        bins = draw.integers(0, crf.BINS, (len(owner), len(crf.EDGES)))
        got = field.mark(bins, owner)
        for k in range(3):
            own = bins[owner == k]

            def value(labels, own=own, field=field):
                return sum(field.weights[b].sum() * y for b, y in zip(own, labels, strict=True)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))

            best = max(itertools.product((0, 1), repeat=len(own)), key=value)
            assert tuple(got[owner == k].astype(int)) == best


def test_the_fitted_field_is_where_the_penalised_likelihood_is_flat():
    """Expected label pairs, summed over all labellings, differ from those told by the penalty alone."""
    draw = np.random.Generator(np.random.PCG64(6))
    owner = np.repeat(np.arange(4), (1, 3, 4, 2))
    bins, label = draw.integers(0, crf.BINS, (10, len(crf.EDGES))), draw.integers(0, 2, 10)
    field = crf.fit(bins, owner, label, steps=3000, rate=0.02)
    slope = -1.0 * field.pairs
    for k in range(4):
        own, told = bins[owner == k], label[owner == k]
        ways = list(itertools.product((0, 1), repeat=len(own)))
        weight = np.exp([sum(field.weights[b].sum() * y for b, y in zip(own, w, strict=True)) + sum(field.pairs[p] for p in itertools.pairwise(w)) for w in ways])
        for p in itertools.pairwise(told.tolist()):
            slope[p] += 1
        for w, chance in zip(ways, weight / weight.sum(), strict=True):
            for p in itertools.pairwise(w):
                slope[p] -= chance
    assert np.abs(slope).max() < 0.02


def test_held_out_documents_are_judged_as_they_are_labelled(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    found = crf.report(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert len(good) > 100 and len(bad) > 15
    assert good[~good.base_failed].kept.mean() > 0.98
    assert bad.kept.mean() < 0.05


def test_lines_are_labelled_one_by_one(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    field = crf.train(docs, labels)
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("n_chars between 600 and 2000 and lang = 'en'").orderBy("doc_id").limit(2).collect()
    clean, other = (r["text"].replace("\n", " ") for r in clean)
    junk = "buy | now | cheap | things | here | and | there | again"
    text = "\n".join([clean, "", junk, junk[6:], junk[3:], other])
    got = crf.label_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).orderBy("line").collect()
    assert [r["line"] for r in got] == [0, 2, 3, 4, 5]
    assert [r["boilerplate"] for r in got] == [False, True, True, True, False]
    assert [text.encode()[r["start"] : r["end"]].decode() for r in got] == [clean, junk, junk[6:], junk[3:], other]


def test_odd_rows(spark):
    rows = [(None, t, "x", 3) for t in ODD] + [(7, "word " * 3, "x", 1)] * 2 + [(8, " ".join(f"w{i}" for i in range(60)), "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = crf.report(docs, none).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r[c] for c in crf._COLUMNS) for r in got) == sorted(plain(t) for _, t, _, _ in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert [r["content_share"] for r in got if not r["n_words"]] == [0.0] * 4
    kept = crf.keep(docs, none)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [8]
    assert crf.report(docs.limit(0), none).count() == 0 and crf.keep(docs.limit(0), none).columns == docs.columns
    # labelled ids that repeat or are null, labels that contradict each other
    labels = spark.createDataFrame([(7, 0), (8, 1), (8, 0), (None, 1), (9, None), (10, 0)], "doc_id long, quality int")
    assert crf.report(docs, labels).count() == len(rows)


@pytest.mark.parametrize("text", ["x" * 3_000_000, "a b\n" * 400_000, ("w%d " * 300_000) % tuple(range(300_000))])
def test_very_long_texts(spark, text):
    (found,) = crf.measure([text])
    assert found.n_words[0] == len(text.split()) and found.word_chars[0] == sum(map(len, text.split()))
    crf.Field(np.zeros(crf.BINS), np.zeros((2, 2))).mark(found.bins, found.owner)
