import random
import zlib

import numpy as np

from snapgraph.llm import toxicity


def corpus(seed, n=1200):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randrange(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(vocabulary, k=random.randrange(20, 120))
        toxic = i % 7 == 0
        if toxic:
            for _ in range(random.randrange(2, 5)):
                words[random.randrange(len(words))] = random.choice(["zounds", "varlet", "knave"]) if i % 2 else "qumble" + random.choice(vocabulary)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(y, got[d].predicted) for d, y in labels if got[d].held_out]
    assert np.mean([p for y, p in held if y]) > 0.85 and np.mean([p for y, p in held if not y]) < 0.02


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    one, two = ({r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert one == two


def test_edge_cases(spark):
    rows, labels = corpus(3, 60)
    rows += [(900, None), (901, ""), (None, "no id"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) and all(r.predicted == 0 for r in got if r.doc_id in (900, 901))
    assert not [r for r in got if r.doc_id is None][0].held_out
    assert toxicity.score(docs.limit(0), known).count() == 0
    assert {r.predicted for r in toxicity.score(docs, known.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, known.where("toxic = 1")).collect()} == {0}


def votes_of(rng, y, accuracy=((0.8, 0.05),) * 4):
    return np.stack([np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false) for hit, false in accuracy], 1).astype(float)


def test_label_model_knows_dependent_voters():
    """Copies of a voter hang on each other and say nothing new; accuracies come from the votes alone."""
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    votes = votes_of(rng, y)
    copies = np.concatenate((votes, np.repeat(votes[:, :1], 5, 1)), 1)
    model = toxicity.LabelModel(copies)
    linked = {0, 4, 5, 6, 7, 8}
    assert sum(model.parent[j] >= 0 for j in linked) == 5 and all(model.parent[j] in linked | {-1} for j in linked)
    assert all(model.parent[j] == -1 for j in (1, 2, 3))
    assert abs(model.rate[1, 1] - 0.8) < 0.08 and abs(model.rate[0, 1] - 0.05) < 0.03 and abs(model.prior - 0.2) < 0.05
    q = model.posterior(copies)
    assert ((q > 0.5) == y).mean() > 0.95 and abs(q - toxicity.LabelModel(votes).posterior(votes)).mean() < 0.05


def test_label_model_by_force():
    """Posteriors are Bayes' rule over the tables; accuracies and the one dependent voter are found."""
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    votes = votes_of(rng, y, ((0.9, 0.02), (0.7, 0.1), (0.6, 0.05), (0.8, 0.05), (0.75, 0.08)))
    extra = np.where(rng.random(4000) < 0.9, votes[:, 2], rng.random(4000) < 0.3)[:, None]
    votes = np.concatenate((votes, extra), 1)
    model = toxicity.LabelModel(votes)
    assert model.parent.tolist().count(-1) == 5 and 2 in (model.parent[5], 2 * (model.parent[2] == 5))
    for row, q in list(zip(votes, model.posterior(votes), strict=True))[:200]:
        joint = [1 - model.prior, model.prior]
        for side in (0, 1):
            for j, v in enumerate(row):
                u = int(row[model.parent[j]]) if model.parent[j] >= 0 else 0
                p = model.table[side, u, j]
                joint[side] *= p if v else 1 - p
        assert abs(joint[1] / sum(joint) - q) < 1e-9
    assert abs(model.rate[1, 0] - 0.9) < 0.06 and abs(model.rate[1, 1] - 0.7) < 0.06 and abs(model.prior - 0.3) < 0.05


def test_very_long_text(spark):
    rows, labels = corpus(4, 300)
    rows += [(5000, "plain words " * 200_000), (5001, "zounds knave varlet " * 100_000)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert (got[5000], got[5001]) == (0, 1)
