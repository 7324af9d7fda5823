import random

import numpy as np
from pyspark.sql import functions as F

from snapgraph.llm import quality


def corpus(seed, n=400):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(vocabulary, k=random.randrange(1, 200))
        bad = i % 5 == 0
        if bad:
            words = random.choices(vocabulary, k=random.randrange(40, 200))
            mess = i % 3
            words = [w.upper() + "!!" for w in words] if mess == 0 else [w + random.choice(["%%%", "&&&"]) for w in words] if mess == 1 else [words[0]] * (len(words) + 8)
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(1)
    docs, known = frames(spark, rows, [x for x in labels if x[0] % 2])
    kept = {r.doc_id for r in quality.sample(docs, known).collect()}
    held = [(d, q) for d, q in labels if d % 2 == 0]
    good = [d in kept for d, q in held if q]
    bad = [d in kept for d, q in held if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_scores_by_force(spark):
    rows, labels = corpus(2, 60)
    docs, known = frames(spark, rows, labels)
    scored, ratios = quality.score(docs, known)
    got = {r.doc_id: r for r in scored.collect()}
    for d, text in rows:
        (_, _, cell, _), = quality.grams([text])
        assert abs(got[d].log_weight - ratios[cell].sum()) < 1e-6
        assert abs(got[d].key - got[d].log_weight - quality._noise(d, "quality")) < 1e-9
    order = sorted(got.values(), key=lambda r: -r.key)
    for k in (1, 7, 60):
        assert {r.doc_id for r in scored.where(F.col("bits") >= quality.kth_largest(scored, k)).collect()} == {r.doc_id for r in order[:k]}


def test_bits_keep_the_order():
    keys = np.array([-np.inf, -1e300, -2.5, -1e-9, -0.0, 0.0, 1e-9, 3.0, 1e300, np.inf])
    bits = quality._bits(keys)
    assert (np.diff(bits) >= 0).all()


def test_cells_do_not_reach_over_texts():
    texts = ["one two", "", None, "two one one", "É é"]
    alone = [np.sort(cell) for t in texts for _, _, cell, _ in quality.grams([t])]
    (_, n, cell, owner), = quality.grams(texts)
    assert n == len(texts)
    for i in range(n):
        assert (np.sort(cell[owner == i]) == alone[i]).all()


def test_edge_cases(spark):
    rows, labels = corpus(3, 30)
    rows += [(100, None), (101, ""), (None, "text of no id"), (5, rows[5][1])]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, label int, key string")
    known = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    out = quality.keep(docs, known)
    assert out.columns == docs.columns
    assert out.count() == quality.sample(docs, known).count()
    assert quality.keep(docs.limit(0), known).count() == 0
    assert quality.keep(docs, known.limit(0)).count() == len(rows)
    assert quality.keep(docs, known.where("quality = 1")).count() == len(rows)


def test_models_by_force(spark):
    """Counts of both models, ratios from them, and the level among all that labelled weights allow."""
    rows, labels = corpus(5, 80)
    docs, known = frames(spark, rows, labels[:60])
    good = {d for d, y in labels[:60] if y}
    raw, target = np.zeros(quality.CELLS), np.zeros(quality.CELLS)
    for d, text in rows:
        for cell in quality.grams([text]).__next__()[2].tolist():
            raw[cell] += 1
            target[cell] += d in good
    with_good = spark.createDataFrame([(t, d in good) for d, t in rows], "text string, good boolean")
    got = quality.counts(with_good)
    assert (got[0] == raw).all() and (got[1] == target).all()
    ratios = quality.log_ratios(raw, target)
    words, outlines = range(quality.WORD_CELLS), range(quality.WORD_CELLS, quality.WORD_CELLS + quality.OUTLINE_CELLS)
    for part, smooth in ((words, quality.SMOOTH), (outlines, quality.SMOOTH_OUTLINES)):
        every, mine = sum(raw[c] + 0.5 for c in part), sum(target[c] for c in part)
        for c in random.sample(list(part), 50):
            q = (raw[c] + 0.5) / every
            assert abs(ratios[c] - np.log((target[c] + smooth * q) / (mine + smooth) / q)) < 1e-9
    scored, _ = quality.score(docs, known)
    weight = {r.doc_id: r.log_weight for r in scored.collect()}
    known_weights = [(weight[d], y) for d, y in labels[:60]]

    def value(level):
        return np.mean([w >= level for w, y in known_weights if y]) + np.mean([w < level for w, y in known_weights if not y])

    floor = quality.level(scored)
    assert value(floor) >= max(value(w) for w, _ in known_weights) - 1e-9
    kept = {r.doc_id for r in quality.sample(docs, known).collect()}
    k = sum(w >= floor for w in weight.values())
    keys = sorted(((weight[d] + quality._noise(d, "quality"), d) for d in weight), reverse=True)
    assert kept == {d for _, d in keys[:k]}


def test_long_texts_and_equal_keys(spark):
    """Weights far beyond hundreds still have a level between them; equal keys are in or out together."""
    rows, labels = corpus(6, 60)
    rows += [(1000, " ".join(t for _, t in rows if t) * 60), (1001, "JUNK!! " * 100_000), (1001, "JUNK!! " * 100_000)]
    docs, known = frames(spark, rows, [*labels, (1000, 1), (1001, 0)])
    scored, _ = quality.score(docs, known)
    weights = {r.doc_id: r.log_weight for r in scored.collect()}
    assert min(weights.values()) < -500 and np.isfinite(quality.level(scored))
    kept = [r.doc_id for r in quality.sample(docs, known).collect()]
    assert kept.count(1001) in (0, 2)
