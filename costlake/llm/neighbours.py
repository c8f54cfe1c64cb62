"""Approximate nearest neighbours by inner product, through stable projections and a kd-tree.

Vectors get one more component, so that a larger inner product is a smaller distance.  Gaussian projections to
``m`` dimensions keep distances in law: the squared projected distance of two points is their squared
distance times a chi-square variable of ``m`` degrees.  Projected points are indexed by a kd-tree whose
upper cells are fitted to a bounded sample and hold every row; inside a cell each task builds the lower
part.  A search takes projected neighbours in growing distance and verifies them by their true inner
product, until the next projected distance is so large that, by the chi-square law, a better one would lie
nearer with probability ``sure``.

Queries first search their own cell, which bounds their k-th distance, then the other cells that this bound
and the same test cannot rule out.  Heavy cells are dealt out as blocks of vectors times blocks of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from costlake.llm.common import written

_LEAF = 128


def chi_square_quantile(sure: float, m: int) -> float:
    """The x with P(chi-square of even ``m`` degrees <= x) = ``sure``."""
    if m % 2:
        raise ValueError("the number of projections must be even")

    def upto(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while upto(high) < sure:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < sure else (low, mid)
    return high


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest dimension down to ``most`` rows."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= most or spread.max() == 0:
            leaves.append(rows)
            continue
        half = len(rows) // 2
        order = np.argpartition(own[:, spread.argmax()], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree of about ``cells`` cells: (dimension, cut, left, right); a child below 0 is cell ``-1 - child``."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        own = sample[rows]
        spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
        if wanted < 2 or len(rows) < 2 or spread.max() == 0:
            count += 1
            return -count
        d = int(spread.argmax())
        cut = float(np.median(own[:, d]))
        if cut >= own[:, d].max():  # more than half lie at the top
            cut = float(own[own[:, d] < cut, d].max())
        no = len(nodes)
        nodes.append((d, cut, 0, 0))
        left = grow(rows[own[:, d] <= cut], wanted // 2)
        right = grow(rows[own[:, d] > cut], wanted - wanted // 2)
        nodes[no] = (d, cut, left, right)
        return no

    root = grow(np.arange(len(sample)), cells)
    return nodes if root >= 0 else []


def cell_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1, np.int64)
    if nodes:
        dims, cuts, left, right = (np.array(x) for x in zip(*nodes))
        while (at >= 0).any():
            live = np.nonzero(at >= 0)[0]
            node = at[live]
            at[live] = np.where(points[live, dims[node]] <= cuts[node], left[node], right[node])
    return -1 - at


def search_block(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, query_ids: np.ndarray,
                 queries: np.ndarray, projected_queries: np.ndarray, bounds: np.ndarray, k: int, factor: float,
                 top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the ``k`` best verified vectors of each query; ``bounds``: known k-th squared
    distances; ``top``: the largest squared norm.  Equal scores keep the smaller ids."""
    leaves = kd_leaves(projected, _LEAF)
    order = np.concatenate(leaves)  # a leaf's rows lie together
    stops = np.cumsum([len(r) for r in leaves])
    ids, vectors, projected = ids[order], vectors[order], projected[order]
    low = np.minimum.reduceat(projected, stops - [len(r) for r in leaves], axis=0)
    high = np.maximum.reduceat(projected, stops - [len(r) for r in leaves], axis=0)
    spans = [(b - len(r), b) for r, b in zip(leaves, stops.tolist())]
    out = []
    for query_id, q, p, bound in zip(query_ids.tolist(), queries, projected_queries, bounds.tolist()):
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        near = (gap * gap).sum(axis=1)
        norm = float((q * q).sum()) + top
        slack = 1e-9 * (norm + 1e-300)
        best = np.full(k, -np.inf)
        rows_kept, scores_kept = [], []
        for leaf in np.argsort(near, kind="stable").tolist():
            if near[leaf] > factor * bound:
                break
            a, b = spans[leaf]
            scores = vectors[a:b] @ q
            good = np.nonzero(scores >= best[0] - slack)[0]
            if not len(good):
                continue
            good = good[ids[a + good] != query_id]
            shift = projected[a + good] - p
            good = good[(shift * shift).sum(axis=1) <= factor * bound]
            if len(good):
                rows_kept.append(a + good)
                scores_kept.append(scores[good])
                best = np.sort(np.concatenate([best, scores[good]]))[-k:]
                bound = min(bound, max(norm - 2 * best[0], 0.0) + slack)
        if rows_kept:
            rows = np.concatenate(rows_kept)
            rows = rows[np.concatenate(scores_kept) >= best[0] - slack]
            exact = (vectors[rows] * q).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            order = np.lexsort((ids[rows], -exact))[:k]
            out.append((np.full(len(order), query_id), ids[rows[order]], exact[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``v`` array<double>) of rows with an id and a non-zero vector of finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, projections: int = 8, sure: float = 0.99,
           cell_rows: int = 4096, block_rows: int = 8192, sample_rows: int = 20_000, most_cells: int = 4096,
           seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank`` from 1, id, ``score``): the ``k`` rows with the largest inner products found.

    ``is_query`` is a condition on column ``id``.  A query is never its own neighbour; ties go to the smaller
    id.  Rows with a null id, or a vector that is null, zero or has null or non-finite components, take no part,
    nor do vectors of another length than the most frequent one.  Rows that repeat an id count as one neighbour and one
    query, with their best score.  The index is fitted on ``sample_rows`` rows and holds all; it has at most
    ``most_cells`` cells.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = usable(vectors, id_col, vector_col).withColumn("size", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    usual = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy(
        F.desc("n"), "size").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    size, total, top = usual[0], usual[1], usual[2]
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((size + 1, projections))
    factor = chi_square_quantile(sure, projections)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, size)
            rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
            as_data = v @ directions[:-1] + rest[:, None] * directions[-1]
            lists = [pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, projections, dtype=np.int32)), pa.array(x.ravel()))
                for x in (as_data, v @ directions[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), *lists, batch.column("asks")], names=["id", "v", "p", "qp", "asks"])

    placed = written(rows.where(F.col("size") == size).select("id", "v", is_query.alias("asks")).mapInArrow(
        project, "id long, v array<double>, p array<double>, qp array<double>, asks boolean"), "projected")
    sample = placed.select("p", F.xxhash64("id").alias("at")).orderBy("at", "p").limit(sample_rows).select("p").toPandas()
    nodes = fit_cells(np.array(sample["p"].tolist()).reshape(-1, projections),
                      min(most_cells, max(1, total // cell_rows)))
    tree = spark.sparkContext.broadcast(nodes)

    def into_cells(batches):
        for batch in batches:
            if batch.num_rows:
                p = np.asarray(batch.column("p").flatten()).reshape(batch.num_rows, -1)
                yield batch.append_column("cell", pa.array(cell_of(tree.value, p), pa.int64()))

    data = placed.select("id", "v", "p").mapInArrow(into_cells, "id long, v array<double>, p array<double>, cell long")
    edges = [f(F.get("p", F.lit(d))).alias(f"{n}{d}") for d in range(projections) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).toPandas()  # at most most_cells rows
    held = dict(zip(boxes["cell"].tolist(), boxes["n"].tolist()))
    corners = spark.sparkContext.broadcast((
        boxes["cell"].to_numpy(), boxes[[f"lo{d}" for d in range(projections)]].to_numpy(),
        boxes[[f"hi{d}" for d in range(projections)]].to_numpy()))
    asked = placed.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "qp")

    def visits_of(batches, again: bool):
        """The cells that each query visits: the nearest one, or all others that its bound leaves."""
        cells, low, high = corners.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.asarray(batch.column("qp").flatten()).reshape(batch.num_rows, -1)
            near = np.zeros((len(p), len(cells)))
            for d in range(p.shape[1]):
                gap = np.maximum(np.maximum(low[None, :, d] - p[:, None, d], p[:, None, d] - high[None, :, d]), 0)
                near += gap * gap
            home = near.argmin(axis=1)
            if again:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                go = near <= factor * bound[:, None]
                go[np.arange(len(p)), home] = False
                row, at = np.nonzero(go)
            else:
                row, at = np.arange(len(p)), home
            yield batch.take(pa.array(row)).append_column("cell", pa.array(cells[at], pa.int64()))

    def run(visits: DataFrame) -> DataFrame:
        """Search every visited cell; a cell is as many tasks as it has blocks of rows and of queries."""
        asking = visits.groupBy("cell").count().collect()  # at most most_cells rows
        shares = [(int(r.cell), -(-held[int(r.cell)] // block_rows), -(-int(r["count"]) // block_rows)) for r in asking]
        parts = spark.createDataFrame(shares or [(-1, 1, 1)], "cell long, v_parts int, q_parts int")
        v_part = F.pmod(F.xxhash64("id"), F.col("v_parts")).cast("int")
        q_part = F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")
        left = data.join(F.broadcast(parts), "cell").select(
            "cell", v_part.alias("vp"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("qn"), "id", "v", "p")
        right = visits.join(F.broadcast(parts), "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1)).alias("vp"), q_part.alias("qn"),
            "query_id", "q", "qp", "bound")

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            found = search_block(
                a["id"].to_numpy(), np.stack(a["v"]), np.stack(a["p"]), b["query_id"].to_numpy(), np.stack(b["q"]),
                np.stack(b["qp"]), b["bound"].to_numpy(), k, factor, top)
            return pd.DataFrame(dict(zip(("query_id", "id", "score"), found)))

        keys = ["cell", "vp", "qn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            block, "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = asked.withColumn("bound", F.lit(math.inf)).mapInArrow(
        lambda b: visits_of(b, False), "query_id long, q array<double>, qp array<double>, bound double, cell long")
    home = written(best(run(first)), "home")
    worst = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    own_norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    bound = F.when(F.col("n") < k, math.inf).otherwise(F.greatest(own_norm + top - 2 * F.col("kth"), F.lit(0.0)))
    second = asked.join(worst, "query_id", "left").select(
        "query_id", "q", "qp", F.coalesce(bound, F.lit(math.inf)).alias("bound")).mapInArrow(
        lambda b: visits_of(b, True), "query_id long, q array<double>, qp array<double>, bound double, cell long")
    others = run(written(second, "visits"))
    return best(home.select("query_id", "id", "score").unionByName(others)).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
