import math
import random

from snapgraph.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    clean = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(clean):
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i is None, i or 0) for m, (i, v) in enumerate(clean) if m != n)[:k]
            out += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scored)]
    return sorted(out, key=repr)


def run(spark, rows):
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_random_vectors(spark):
    random.seed(2)
    run(spark, [(i, [random.gauss(0, 0.3) for _ in range(24)]) for i in range(400)])


def test_many_equal_vectors(spark):
    random.seed(3)
    run(spark, [(i, [0.5, -0.25, 0.125] if i % 3 else [random.random() for _ in range(3)]) for i in range(300)])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 0.0]), (1, [-1.0, 0.5]), (2, [1.0]), (3, []), (None, [1.0, 1.0]), (1, [-1.0, 0.5])]
    assert {q for q, *_ in run(spark, rows)} == {0}
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []


def test_ragged_vectors_and_null_ids(spark):
    assert run(spark, [(0, [1.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0])]) == [(0, 1, 0, 65_536), (0, 1, 0, 65_536), (0, 2, 1, 32_768), (0, 2, 1, 32_768)]
    assert run(spark, [(None, [2.0]), (0, [1.0]), (3, [2.0]), (None, [2.0])]) == [(0, 1, 3, 131_072), (0, 2, None, 131_072), (0, 3, None, 131_072)]
    random.seed(7)
    run(spark, [(random.choice([None, i, i, 50]), [random.choice([-1.0, 0.5, 0.0]) for _ in range(random.randrange(4))]) for i in range(150)])


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    random.seed(5)
    run(spark, [(i * 25, [random.random() for _ in range(6)]) for i in range(14)])


def test_rows_that_share_an_id_or_repeat(spark):
    got = run(spark, [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1.0, 1.0])])
    assert (0, 1, 0, 327_680) in got
    random.seed(6)
    rows = [(random.choice([0, 50, 100, i]), [random.choice([-1.0, 0.5, 2.0]) for _ in range(2)]) for i in range(120)]
    run(spark, rows + rows[:30])
