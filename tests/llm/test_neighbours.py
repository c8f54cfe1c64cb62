"""Nearest neighbours against brute force, and the odd inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from costlake.llm import neighbours


def brute(rows, k):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if q % 5 == 0:
            scores = {}
            for i, b in fine:
                if i != q:
                    scores[i] = max(scores.get(i, -math.inf), float((a * b).sum()))
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(spark, rows, k=10, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as id", "3 as q", "4 as p")
    out = {}
    for r in neighbours.search(df, F.col("id") % 5 == 0, k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 8))
    points = centers[rng.integers(0, 12, 900)] * rng.uniform(0.5, 2, (900, 1)) + 0.2 * rng.standard_normal((900, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(1000 + i, points[7].tolist()) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [math.nan] * 8), (2004, [1.0, math.inf] * 4),
             (None, points[0].tolist()), (2005, [1.0] * 3), (2010, [])]
    want = brute(rows, 10)
    got = found(spark, rows, cell_rows=100, block_rows=64)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    same = [q for q in want if q >= 1000]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in same)  # ties by the smaller id
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q in got for i, s in got[q])


def test_few_rows_and_none(spark):
    assert found(spark, []) == {} and found(spark, [(5, [1.0] * 8)]) == {}
    got = found(spark, [(5, [1.0] + [0.0] * 7), (6, [2.0] + [0.0] * 7), (7, [1.0] * 8)])
    assert got == {5: [(6, 2.0), (7, 1.0)]}


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991) < 1e-3
    assert abs(neighbours.chi_square_quantile(0.99, 8) - 20.090) < 1e-3
