"""Vector codes and clusters against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from snapgraph.llm import clusters, codes, lloyd


def nearest(x, centres):
    ways = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres]
    return ways.index(min(ways)), min(ways)


def rounds_of(vectors, centres, rounds):
    """Plain rounds: (assignments, squared distances, centres)."""
    for n in range(rounds + 1):
        found = [nearest(x, centres) for x in vectors]
        if n == rounds:
            return [c for c, _ in found], [d for _, d in found], centres
        for k in range(len(centres)):
            own = [x for x, (c, _) in zip(vectors, found, strict=True) if c == k]
            if own:
                centres = [*centres[:k], [sum(column) // len(own) for column in zip(*own, strict=True)], *centres[k + 1 :]]


def made(n, width, seed, spread=0.2, groups=7):
    draw = np.random.Generator(np.random.PCG64(seed))
    middle = draw.normal(size=(groups, width))
    return (middle[draw.integers(0, groups, n)] + spread * draw.normal(size=(n, width))).astype(np.float32).tolist()


def whole(vector, width=None):
    held = [max(-lloyd.LIMIT, min(lloyd.LIMIT, math.floor(1024 * x))) for x in vector]
    return held + [0] * ((width or len(held)) - len(held))


def bad(vector):
    return vector is None or any(x is None or not math.isfinite(x) for x in vector)


def codes_by_force(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if not bad(v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = sorted(((i, whole(v, width * parts), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        own = [v[p * width : (p + 1) * width] for _, v, _ in kept]
        a, d, book = rounds_of(own, own[:entries], rounds)
        books += [str(c) for entry in book for c in entry]
        code, error = [x + f"{y:02x}" for x, y in zip(code, a, strict=True)], [x + y for x, y in zip(error, d, strict=True)]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for (i, _, label), c, e in zip(kept, code, error, strict=True)), key=repr)


def clusters_by_force(rows, k, rounds, width):
    kept = [(i, whole(v)) for i, v in rows if not bad(v) and len(v) == width]
    lot = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    a, d, centres = rounds_of([v for _, v in kept], [v for _, v in sorted(kept, key=lot)[:k]], rounds)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, e, sum(y for x, y in zip(a, d, strict=True) if x == c), sum(d), sha[c]) for (i, _), c, e in zip(kept, a, d, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


KIND = "vec_id long, embedding array<float>, label int, code string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)


def test_codes_equal_plain_rounds(spark):
    vectors = made(300, 12, 1) + made(40, 12, 1)[:40]
    rows = [(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors)]
    assert got(codes.report(frame(spark, rows).repartition(5), entries=20, rounds=6)) == codes_by_force(rows, 4, 20, 6)


def test_bounds_spare_searches(spark):
    """In well-separated groups most parts are settled by their bounds."""
    rows = [(i, v, 0) for i, v in enumerate(made(500, 8, 3, spread=0.01, groups=5))]
    _, books = codes.fit(frame(spark, rows), parts=2, entries=5, rounds=5)
    assert books.searched[0] > 0.5 and books.searched[-1] < 0.2
    _, found = clusters.fit(frame(spark, rows), k=5, width=8, rounds=5)
    assert found.scanned[-1] < 0.5 * found.scanned[0] + 1e-9


def test_clusters_equal_plain_rounds(spark):
    rows = [(i, v, 0) for i, v in enumerate(made(400, 10, 2))]
    assert got(clusters.report(frame(spark, rows).repartition(5), width=10)) == clusters_by_force([r[:2] for r in rows], 8, 10, 10)


@pytest.mark.parametrize("seed", range(4))
def test_ties_go_to_the_smaller_number(spark, seed):
    """Few whole positions, so that many distances are equal, and centres are equal too."""
    draw = np.random.Generator(np.random.PCG64(seed))
    rows = [(i, [float(x) / 1024 for x in draw.integers(-2, 3, 4)], 0) for i in range(120)]
    df = frame(spark, rows)
    assert got(codes.report(df, parts=2, entries=30, rounds=3)) == codes_by_force(rows, 2, 30, 3)
    assert got(clusters.report(df, k=9, width=4, rounds=4)) == clusters_by_force([r[:2] for r in rows], 9, 4, 4)


ODD = [
    (5, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], 1), (5, [0.5, 2.0, 3.0], 1), (None, [1.5, 1.0, 1.0, 9.0], None), (None, [1.5, 1.0, 1.0, 9.0], 2),
    (1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (3, [float("nan"), 1.0, 1.0, 1.0], 1), (4, [float("inf"), 1.0, 1.0, 1.0], 1), (6, [], 1), (7, [3e38, -3e38, 1e5, 1.0], 3), (8, [-0.00001, 0.0, 0.0, 0.0], 3),
]


def test_odd_rows(spark):
    df = frame(spark, ODD)
    assert got(codes.report(df)) == codes_by_force(ODD, 4, 256, 4)
    assert got(clusters.report(df, width=4)) == clusters_by_force([r[:2] for r in ODD], 8, 10, 4)
    for empty in (df.limit(0), df.where("vec_id = 1")):
        assert codes.report(empty).count() == 0 and clusters.report(empty).count() == 0
    only = [(6, [], None)] * 3
    assert got(codes.report(frame(spark, only))) == codes_by_force(only, 4, 256, 4)


def test_the_queries_equal_their_sql_and_plain_rounds(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    for module in (codes, clusters):
        mine, res = module.report(df), con.sql(module.sql())
        assert mine.columns == res.columns and got(mine) == sorted(res.fetchall(), key=repr)
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    assert got(clusters.report(df)) == clusters_by_force(rows, 8, 10, 64)


def test_distances_are_exact_for_large_components():
    draw = np.random.Generator(np.random.PCG64(9))
    x, c = draw.integers(-lloyd.LIMIT, lloyd.LIMIT, (5, 64)), draw.integers(-lloyd.LIMIT, lloyd.LIMIT, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert lloyd.distances(x, c).tolist() == want and lloyd.own(x[:3], c).tolist() == [want[i][i] for i in range(3)]
