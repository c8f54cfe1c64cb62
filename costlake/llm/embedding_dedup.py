"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own, fitted on a bounded sample; a vector lies in
the cell (i, j) of its nearest codewords, so k codewords a half make a grid of k * k cells.  A vector visits the
cells of the grid in growing distance: the two sorted lists of codeword distances are traversed like a
staircase until the sum exceeds that of its own cell by a slack.  The slack is set on the sample, by pairs
placed exactly at the least cosine, so that the wished share of them meets in a visit of one of the two.

In a cell all who visit it are compared with its members in double precision.  What comes out is each vector's number of
links and a spanning forest of them, never the pairs.  Equal vectors are one class with a weight.  Cells with
too many rows are dealt out as blocks of visitors times blocks of members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import written
from costlake.llm.simhash import components


def usable(vector: Column) -> Column:
    """Whether all components are there and finite, and one is not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of length one, filled up with zeros to ``width``."""
    lengths = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def codebook(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``k`` means of the points by Lloyd's rounds; a codeword that no point chose stays where it is."""
    points = points[rng.permutation(len(points))]
    words = np.unique(points[:4 * k], axis=0)
    words = words[rng.permutation(len(words))[:k]]
    for _ in range(rounds):
        of = distances(points, words).argmin(axis=1)
        sizes = np.bincount(of, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, of, points)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


def distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, without the points' own squares: they do not change an order or a difference."""
    return (words**2).sum(axis=1) - 2 * points @ words.T


class Grid:
    """Two codebooks and the slack of a visit."""

    def __init__(self, sample: np.ndarray, k: int, least: float, recall: float):
        rng = np.random.default_rng(13)
        self.half = (sample.shape[1] + 1) // 2
        self.words = [codebook(part, k, rng) for part in (sample[:, :self.half], sample[:, self.half:])]
        self.slack = 0.0
        self.slack = self._slack(sample, least, recall, rng)

    def excess(self, points: np.ndarray) -> list[np.ndarray]:
        """How much further than its nearest codeword every codeword of a half is."""
        found = [distances(p, w) for p, w in zip((points[:, :self.half], points[:, self.half:]), self.words)]
        return [d - d.min(axis=1, keepdims=True) for d in found]

    def cells(self, excess: list[np.ndarray]) -> np.ndarray:
        return excess[0].argmin(axis=1) * len(self.words[1]) + excess[1].argmin(axis=1)

    def _slack(self, sample: np.ndarray, least: float, recall: float, rng: np.random.Generator) -> float:
        """The slack by which ``recall`` of the pairs with cosine ``least`` meet.

        Partners lie in random directions and, in equal number, in the directions of other vectors.
        """
        x = sample[rng.integers(0, len(sample), 4000)]
        aside = rng.standard_normal(x.shape) * (x != 0).any(axis=0)
        aside[::2] = sample[rng.integers(0, len(sample), len(aside[::2]))]
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        y = least * x + np.sqrt(max(0.0, 1 - least**2)) * aside / np.where(size > 1e-9, size, 1)
        both = [self.excess(x), self.excess(y)]
        needed = []
        for mine, other in (both, both[::-1]):
            cell = self.cells(other)
            row, n = np.arange(len(x)), len(self.words[1])
            needed.append(mine[0][row, cell // n] + mine[1][row, cell % n])
        return float(np.quantile(np.minimum(*needed), recall)) + 1e-9

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each point; row and cell of every visit, the own cell's included, nearest first)."""
        excess = self.excess(points)
        order = [np.argsort(e, axis=1, kind="stable") for e in excess]
        first, second = (np.take_along_axis(e, o, axis=1) for e, o in zip(excess, order))
        n, rows, cells, reached = len(self.words[1]), [], [], []
        for a in range(first.shape[1]):  # down the staircase: the further the first half, the fewer of the second
            at = np.nonzero(first[:, a] <= self.slack)[0]
            if not len(at):
                break
            for b in range(second.shape[1]):
                sums = first[at, a] + second[at, b]
                near = sums <= self.slack
                at, sums = at[near], sums[near]
                if not len(at):
                    break
                rows.append(at)
                cells.append(order[0][at, a] * n + order[1][at, b])
                reached.append(sums)
        rows, cells, reached = (np.concatenate(x) for x in (rows, cells, reached))
        nearest = np.lexsort((reached, rows))
        return order[0][:, 0] * n + order[1][:, 0], rows[nearest], cells[nearest]


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects; a name may stand for a row and for a column."""
    found, seen = [], np.zeros(len(columns), bool)
    place = dict(zip(columns.tolist(), range(len(columns))))
    unseen_rows = np.ones(len(rows), bool)
    for start in np.nonzero(linked.any(axis=1))[0].tolist():
        if not unseen_rows[start]:
            continue
        unseen_rows[start] = False
        waiting = [start]
        while waiting:
            row = waiting.pop()
            name = int(rows[row])
            fresh = linked[row] & ~seen
            if (here := place.get(name)) is not None:
                fresh[here] |= not seen[here]
            for column in np.nonzero(fresh)[0].tolist():
                seen[column] = True
                if (other := int(columns[column])) != name:
                    found.append((name, other))
                more = linked[:, column] & unseen_rows
                more |= (rows == other) & unseen_rows
                unseen_rows[more] = False
                found.extend((other, int(r)) for r in rows[more].tolist() if int(r) != other)
                waiting.extend(np.nonzero(more)[0].tolist())
    return found


def compare(table: pa.Table, width: int, least: float) -> pa.Table:
    """Partial counts and a forest of links of one block: (``node``, ``other`` or null, ``links``)."""
    table = table.combine_chunks()
    node, weight, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
    cell = table.column("cell")[0].as_py()
    vectors = pa.concat_arrays(table.column("v").chunks)
    x = units(vectors, width)
    asks = np.nonzero(table.column("asks").to_numpy(zero_copy_only=False))[0]
    member = np.nonzero(table.column("member").to_numpy(zero_copy_only=False))[0]
    linked = x[asks] @ x[member].T >= least
    linked &= node[asks][:, None] != node[member]
    links = np.zeros(len(node), np.int64)
    links[asks] += (linked @ weight[member].astype(np.float64)).astype(np.int64)
    # a visitor counts for a member, too, unless that member counts it when visiting the visitor's own cell
    visits = pa.concat_arrays(table.column("visits").chunks).take(pa.array(member))
    flat, owner = visits.flatten().to_numpy(), np.repeat(np.arange(len(member)), visits.value_lengths().to_numpy())
    guests = own[asks] != cell
    for home in np.unique(own[asks][guests]).tolist():
        theirs = own[asks] == home
        sums = (weight[asks][theirs].astype(np.float64) @ linked[theirs]).astype(np.int64)
        sums[owner[flat == home]] = 0
        links[member] += sums
    pairs = forest(linked, node[asks], node[member])
    some = links > 0
    return pa.table({
        "node": pa.array(np.concatenate([node[some], np.array([a for a, _ in pairs], np.int64)])),
        "other": pa.array([None] * int(some.sum()) + [b for _, b in pairs], pa.int64()),
        "links": pa.array(np.concatenate([links[some], np.zeros(len(pairs), np.int64)]))})


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.99, sample: int = 20_000,
                    per_cell: int = 64, most_words: int = 1024, most_rows: int = 4096, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id`` and ``kept``; links are pairs found with cosine >= ``least``.

    ``sample`` bounds the vectors that the two codebooks (of at most ``most_words`` words) and the slack are fitted
    on; all vectors are indexed and searched.  Vectors of different lengths do not link; null vectors and those with null or
    non-finite components or without any but zeros link with nothing and stay.  Rows that repeat count as vectors of
    their own.  A component's id is its smallest non-null id; a row without an id is never the kept one.  The
    work in a dense group grows with its square, as counting every member's links does; memory does not.  An
    empty table gives none.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).withColumn(
        "key", F.when(usable(F.col("v")), F.unhex(F.sha2(F.array_join(F.transform(
            "v", lambda x: x.cast("string")), ","), 256))))
    classes = written(rows.where("key is not null").groupBy("key").agg(
        F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    size, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not size:
        placed = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return placed.select(F.col("id").alias(id_col), "n_links", "component_id",
                             F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    share = min(1.0, sample / size)
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)) if share < 1 else F.lit(True))
    drawn = pa.concat_arrays(drawn.select("v").limit(2 * sample).toArrow().column("v").chunks)
    grid = Grid(units(drawn, width), int(np.clip(round((size / per_cell) ** 0.5), 1, most_words)), least, recall)
    grid = classes.sparkSession.sparkContext.broadcast(grid)  # two codebooks of at most ``most_words`` words

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own, row, cell = grid.value.visits(units(part.column("v"), width))
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own), pa.ListArray.from_arrays(pa.array(ends), pa.array(cell))],
                    names=[*part.schema.names, "own", "visits"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = written(classes.select("node", "n", "v").mapInArrow(
        assign, f"node long, n long, v {kind}, own long, visits array<long>"), "placed")
    rows_out = placed.withColumn("dim", F.size("v")).withColumn("cell", F.explode("visits"))
    heavy = rows_out.groupBy("dim", "cell").agg(
        F.count("*").alias("asking"), F.count_if(F.col("cell") == F.col("own")).alias("members"))
    heavy = heavy.where(F.greatest("asking", "members") > most_rows).select(
        "dim", "cell", F.ceil(F.col("asking") / most_rows).cast("int").alias("ask_blocks"),
        F.greatest(F.ceil(F.col("members") / most_rows).cast("int"), F.lit(1)).alias("member_blocks"))
    dealt = rows_out.join(heavy, ["dim", "cell"], "left").withColumn(
        "ask_blocks", F.coalesce("ask_blocks", F.lit(1))).withColumn("member_blocks", F.coalesce("member_blocks", F.lit(1)))
    a, m = F.pmod(F.xxhash64("node"), F.col("ask_blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("member_blocks"))
    dealt = dealt.withColumn("a", a.cast("int")).withColumn("m", m.cast("int")).withColumn("at_home", F.expr("cell = own"))

    def seat(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"))

    asked = F.transform(F.sequence(F.lit(0), F.col("member_blocks") - 1), lambda j: seat(F.col("a"), j))
    hosted = F.transform(F.filter(F.sequence(F.lit(0), F.col("ask_blocks") - 1), lambda i: i != F.col("a")),
                         lambda i: seat(i, F.col("m")))
    dealt = dealt.withColumn("seat", F.explode(F.when(F.col("at_home"), F.concat(asked, hosted)).otherwise(asked))).select(
        "dim", "cell", "seat.i", "seat.j", "node", "n", "v", "own", "visits", (F.col("seat.i") == F.col("a")).alias("asks"),
        (F.col("at_home") & (F.col("seat.j") == F.col("m"))).alias("member"))
    found = written(dealt.groupBy("dim", "cell", "i", "j").applyInArrow(
        lambda table: compare(table, width, least), "node long, other long, links long"), "links")
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("key", "node", "least", "n").join(links, "node", "left").join(roots, "node", "left").select(
        "key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    known = written(known, "known")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select("key", "n_links", "component_id")
    lonely = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = rows.where("key is not null").select("id", "key").join(known, "key").drop("key").unionByName(lonely)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
