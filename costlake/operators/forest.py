"""Isolation forest over feature rows (Liu, Ting & Zhou, ICDM 2008).

Training rows are assigned to trees by a hash of their key, about 256 per tree, so a tree task holds
a few hundred rows whatever the size of the input, and the model does not depend on partitioning.
The model is a table of at most ``trees * 511`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costlake.operators.anomaly import FEATURES, baseline_stats

#: Expected share of anomalies per sensitivity, and the fewest rows to train on.
SENSITIVITY = {"low": 0.05, "medium": 0.10, "high": 0.15}
MIN_TRAINING_ROWS = 14

_HASH_SPACE = 2**31
_PARTS = ("nodes", "baseline", "meta")
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path_length double"


@dataclass(frozen=True)
class Forest:
    """A trained detector: node table, score limit and the baseline it was trained on."""

    nodes: DataFrame
    limit: float
    baseline: DataFrame
    sample_size: float
    features: tuple[str, ...] = FEATURES


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes of one random tree; the children of node ``i`` are ``2i + 1`` and ``2i + 2``."""
    nodes, pending = [], [(0, 0, values)]
    while pending:
        node, depth, rows = pending.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or len(varied) == 0:
            nodes.append((node, -1, 0.0, depth + _average_path(len(rows))))
            continue
        feature = int(rng.choice(varied))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= threshold
        nodes.append((node, feature, threshold, 0.0))
        pending += [(2 * node + 1, depth + 1, rows[goes_left]),
                    (2 * node + 2, depth + 1, rows[~goes_left])]
    return nodes


def fit_nodes(
    features: DataFrame, key: Sequence[str], columns: Sequence[str] = FEATURES,
    trees: int = 100, rows_per_tree: int = 256, seed: int = 42,
) -> tuple[DataFrame, int]:
    """Node table and row count of a forest grown on the feature rows."""
    total = features.count()
    if total < MIN_TRAINING_ROWS:
        raise ValueError(f"insufficient data: need at least {MIN_TRAINING_ROWS} rows, got {total}")
    cut = min(_HASH_SPACE, math.ceil(_HASH_SPACE * rows_per_tree / total))
    columns = list(columns)

    def draws(tree):
        return F.pmod(F.xxhash64("_row", tree, F.lit(seed)), F.lit(_HASH_SPACE)) < cut

    # the key is hashed once per row, and that hash once per tree
    sampled = features.select(*key, *columns, F.xxhash64(*key).alias("_row")).select(
        *key, *columns,
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), draws)).alias("tree"),
    )
    depth = max(1, math.ceil(math.log2(max(2, min(rows_per_tree, total)))))
    key_columns = list(key)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # a fixed row order makes the tree independent of how the rows arrived
        rows = rows.sort_values([*key_columns, *columns], kind="stable")
        values = rows[columns].to_numpy(dtype=float)
        grown = _grow(values, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "path_length"])
        out.insert(0, "tree", tree)
        return out

    return sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA), total


def _scorer(nodes: pd.DataFrame, columns: Sequence[str], sample_size: float):
    """Vectorized scoring: all rows walk all trees together, one level at a time.

    The trees lie behind one another in flat arrays; a leaf points to itself.
    """
    flat = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    tree, node = flat["tree"].to_numpy(np.int64), flat["node"].to_numpy(np.int64)
    width = int(node.max()) * 2 + 3
    position = {key: i for i, key in enumerate(tree * width + node)}
    leaf = flat["feature"].to_numpy() < 0
    own = np.arange(len(flat))

    def child(side: int) -> np.ndarray:
        keys = tree * width + 2 * node + side
        return np.array([i if leaf[i] else position[keys[i]] for i in own], dtype=np.int64)

    left, right = child(1), child(2)
    feature = np.where(leaf, 0, flat["feature"].to_numpy())
    threshold, length = flat["threshold"].to_numpy(), flat["path_length"].to_numpy()
    roots = np.flatnonzero(node == 0)
    depth = int(np.ceil(np.log2(node.max() + 2)))
    scale = _average_path(sample_size) or 1.0

    def score(values: np.ndarray) -> np.ndarray:
        rows = np.arange(len(values))[:, None]
        at = np.broadcast_to(roots, (len(values), len(roots)))
        for _ in range(depth):
            at = np.where(values[rows, feature[at]] > threshold[at], right[at], left[at])
        return -np.power(2.0, -length[at].mean(axis=1) / scale)

    return score


def raw_scores(
    features: DataFrame, nodes: DataFrame, sample_size: float, columns: Sequence[str] = FEATURES
) -> DataFrame:
    """Add ``raw_score`` in [-1, 0]; lower means easier to isolate."""
    spark = features.sparkSession
    # bounded: trees x 511 rows, whatever the input
    table = spark.sparkContext.broadcast(nodes.toPandas())
    columns = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(table.value, columns, sample_size)
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            # rows x trees cells at a time, so that a batch of any length fits
            parts = [score(values[i:i + 2_000]) for i in range(0, len(values), 2_000)]
            batch["raw_score"] = np.concatenate(parts) if parts else []
            yield batch

    schema = T.StructType(features.schema.fields + [T.StructField("raw_score", T.DoubleType())])
    return features.mapInPandas(run, schema)


def iforest_fit(
    features: DataFrame, key: Sequence[str], sensitivity: str = "medium", path: str | None = None,
    columns: Sequence[str] = FEATURES, trees: int = 100, rows_per_tree: int = 256, seed: int = 42,
) -> Forest:
    """Train a detector; ``path`` keeps its tables, which later jobs read back instead of training.

    ``path/scores`` has the training rows with their ``raw_score``: rows that are also to be judged need no second
    pass (see :func:`iforest_score`).  Axis-parallel random splits do not depend on the scale of a feature, so none is rescaled.
    """
    contamination = SENSITIVITY.get(sensitivity, SENSITIVITY["medium"])
    nodes, total = fit_nodes(features, key, columns, trees, rows_per_tree, seed)
    if path is not None:
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        nodes = features.sparkSession.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
    grown = nodes.filter("node = 0").count()
    if grown != trees:
        raise ValueError(f"only {grown} of {trees} trees drew a row")
    size = float(min(rows_per_tree, total))
    scored = raw_scores(features, nodes, size, columns)
    if path is not None:
        scored.write.mode("overwrite").parquet(f"{path}/scores")
        scored = features.sparkSession.read.schema(scored.schema).parquet(f"{path}/scores")
    # a mergeable sketch: rank error below total / 100,000 in bounded memory
    limit = scored.agg(F.percentile_approx("raw_score", contamination, 100_000)).first()[0]
    baseline = baseline_stats(features, exact=False)
    if path is not None:
        meta = features.sparkSession.range(1).select(
            F.lit(float(limit)).alias("score_limit"), F.lit(size).alias("sample_size"),
            F.lit(",".join(columns)).alias("features"), F.lit(sensitivity).alias("sensitivity"),
        )
        baseline.coalesce(1).write.mode("overwrite").parquet(f"{path}/baseline")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        _sums(features.sparkSession, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return load_forest(features.sparkSession, path)
    return Forest(nodes, float(limit), baseline, size, tuple(columns))


def _sums(spark: SparkSession, path: str) -> DataFrame:
    """(``part``, ``rows``, ``checksum``) of what makes up a saved detector, as it can be read now."""
    found = []
    for part in _PARTS:
        rows = spark.read.parquet(f"{path}/{part}")
        # the order of rows does not matter; a row that comes twice does
        found.append(rows.agg(F.lit(part).alias("part"), F.count("*").alias("rows"), F.sum(
            F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("checksum")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def load_forest(spark: SparkSession, path: str) -> Forest | None:
    """A saved detector, or ``None`` (unfitted) if any part of it is missing, unreadable or not what was saved.

    The manifest is written last, with the rows and the checksum of every part: a save that was cut short has none.
    """
    try:
        saved = {tuple(row) for row in spark.read.parquet(f"{path}/manifest").collect()}  # one row a part
        if len(saved) != len(_PARTS) or saved != {tuple(row) for row in _sums(spark, path).collect()}:
            return None
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
        baseline = spark.read.parquet(f"{path}/baseline")
        if meta is None or nodes.filter("node = 0").count() == 0 or baseline.first() is None:
            return None
        return Forest(nodes, meta["score_limit"], baseline, meta["sample_size"],
                      tuple(meta["features"].split(",")))
    except Exception:  # any damage means the detector must be trained again
        return None


def iforest_score(features: DataFrame, forest: Forest) -> DataFrame:
    """Add ``label`` (-1 anomaly, 1 normal), signed ``score`` (negative is worse), ``is_anomaly``.

    Rows that carry a ``raw_score`` of this forest are not scored again.
    """
    scored = features if "raw_score" in features.columns else raw_scores(
        features, forest.nodes, forest.sample_size, forest.features)
    return (
        scored.withColumn("score", F.col("raw_score") - F.lit(forest.limit))
        .withColumn("is_anomaly", F.col("score") < 0)
        .withColumn("label", F.when(F.col("is_anomaly"), -1).otherwise(1))
        .drop("raw_score")
    )
