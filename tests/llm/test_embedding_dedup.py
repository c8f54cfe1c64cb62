"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlake.llm import embedding_dedup as ed


def brute(rows, least=0.95):
    """id by row number -> (n_links, component_id)."""
    good = [v is not None and len(v) > 0 and None not in v and all(np.isfinite(v)) and any(v) for _, v in rows]
    n, parent = len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.asarray(rows[k][1], np.float64) for k in (i, j))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[top(i)] = top(j)
    least_id = {}
    for i in range(n):
        if rows[i][0] is not None:
            least_id[top(i)] = min(rows[i][0], least_id.get(top(i), rows[i][0]))
    return sorted((r[0] if r[0] is not None else -1, links[i], least_id.get(top(i), -1)) for i, r in enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).withColumn(
        "cell", F.lit(0)).repartition(3)
    got = ed.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(tuple(-1 if x is None else x for x in (r.vec_id, r.n_links, r.component_id)) for r in got)


def cloud(seed, groups, size, dim=16, noise=0.045, lone=200):
    """Groups around random centres, so that some pairs inside lie at either side of 0.95."""
    rng = np.random.default_rng(seed)
    made = [c + noise * rng.standard_normal(dim) for c in rng.standard_normal((groups, dim)) / dim**0.5 for _ in range(size)]
    made += list(rng.standard_normal((lone, dim)))
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(made)), made)]


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [float("nan")] * 16),
       (905, [float("inf")] + [1.0] * 15), (906, [1e200] * 16), (907, [2e200] * 16), (908, [1e-200] * 16),
       (909, [1.0] * 15), (910, [1.0] * 14 + [0.0]), (None, [1.0] * 16), (None, None), (911, [1.0] * 16), (911, [1.0] * 16)]


def test_odd_vectors_copies_and_null_ids(spark):
    rows = ODD + [(1000 + i, [float(j == i % 3) for j in range(16)]) for i in range(30)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("most_rows", [4096, 7])
def test_counts_equal_all_pairs_where_every_cell_is_visited(spark, most_rows):
    """With the whole recall wished for, the slack covers every calibrated pair; blocks of 7 split every cell."""
    rows = cloud(1, 12, 10, lone=60)
    assert found(spark, rows, recall=1.0, per_cell=20, most_rows=most_rows) == brute(rows)


def test_recall_and_precision_at_production_settings(spark):
    rows = cloud(2, 60, 12, dim=64, noise=0.024, lone=1000)
    got, want = found(spark, rows, per_cell=8), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the bound
    total = sum(w[1] for w in want)
    assert total > 2000 and sum(g[1] for g in got) >= 0.97 * total


def test_a_hot_group_is_counted_in_blocks(spark):
    rows = cloud(3, 1, 120, noise=0.02, lone=240)
    assert found(spark, rows, recall=1.0, per_cell=40, most_rows=16) == brute(rows)


def test_empty_table_and_no_usable_vector(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None), (None, [0.0])]) == [(-1, 0, -1), (3, 0, 3)]


def test_visits_are_the_cells_within_the_slack():
    rng = np.random.default_rng(4)
    points = rng.standard_normal((300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    grid = ed.Grid(points, 6, 0.95, 0.9)
    own, rows, cells = grid.visits(points)
    first, second = grid.excess(points)
    sums = (first[:, :, None] + second[:, None, :]).reshape(300, -1)
    assert {(int(r), int(c)) for r, c in zip(rows, cells)} == {
        (int(r), int(c)) for r, c in zip(*np.nonzero(sums <= grid.slack))}
    assert (cells[np.searchsorted(rows, np.arange(300))] == own).all() and (own == sums.argmin(axis=1)).all()
