"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics are counted per document inside Arrow batches.  A bounded, hash-ordered sample of the
labelled rows is binned and boosted on the driver; the trees become flat arrays that are broadcast
(at most ``trees * 2 ** (depth + 1)`` nodes) and walked by whole numpy columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from costlake.llm.common import slices, text_of

FEATURES = (
    "chars", "words", "mean_word", "long_words", "short_words", "word_spread", "upper", "digits",
    "punctuation", "symbols", "spaces", "non_ascii", "control", "byte_entropy", "distinct_words",
    "top_word", "top_gram", "repeated_grams", "lines", "mean_line", "repeated_lines", "line_stops",
    "symbol_words", "stops", "sentence_words", "commas", "vowels", "letter_runs", "brackets", "links",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=+_\\`")] = True
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 above ASCII, 8 control
_KIND[ord("a"):ord("z") + 1], _KIND[ord("A"):ord("Z") + 1], _KIND[ord("0"):ord("9") + 1] = 1, 2, 3
_KIND[33:127][_KIND[33:127] == 0] = 4
_KIND[_SYMBOL] = 5
_KIND[128:] = 7
_KIND[:32] = 8
_KIND[127] = 8
_KIND[list(b" \t\n\r\v\f")] = 6


def statistics(text: str) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    octets = np.frombuffer(raw, np.uint8)
    counts = np.bincount(octets, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    words = raw.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    codes: dict[bytes, int] = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    seen = np.bincount(coded) if words else np.zeros(1, np.int64)
    top_gram = repeated = 0.0
    if len(words) > 2:
        base = len(codes)
        pairs = coded[:-2] * base + coded[1:-1]
        if base >= 2_000_000:  # numbered by rank, so that three words fit 64 bits too
            pairs = np.unique(pairs, return_inverse=True)[1]
        grams = np.sort(pairs * base + coded[2:])
        edges = np.nonzero(np.append(True, grams[1:] != grams[:-1]))[0]
        times = np.diff(np.append(edges, len(grams)))
        top_gram = times.max() / len(grams)
        repeated = times[times > 1].sum() / len(grams)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    share = counts[counts > 0] / n
    stops = int(counts[ord(".")] + counts[ord("!")] + counts[ord("?")])
    lead = octets[np.append(True, octets[:-1] <= 32)] if n > 1 else octets
    tail = octets[:-1][octets[1:] <= 32]
    same = octets[1:] == octets[:-1]
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), (lengths > 14).sum() / m, (lengths < 3).sum() / m,
        lengths.std(), kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        kinds[8] / n, float(-(share * np.log2(share)).sum()), len(codes) / m ** 0.8,
        seen.max() / m, top_gram, repeated, np.log1p(len(lines)), np.log1p(n / k),
        1 - len(set(lines)) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        (_SYMBOL[tail].sum() + _SYMBOL[lead].sum()) / m, stops / m, m / (stops + 1),
        counts[ord(",")] / m, counts[list(b"aeiouAEIOU")].sum() / n,
        (same & (octets[1:] > 32)).sum() / n, counts[list(b"()[]{}")].sum() / n,
        (raw.count(b"http") + raw.count(b"www.")) / m,
    ]


def _with_statistics(rows: DataFrame, text_col: str, use: Callable[[np.ndarray], pa.Array], name: str,
                     kind: str) -> DataFrame:
    """``rows`` with one more column: ``use`` of the statistics of each text."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 8 << 20):
                table = np.array([statistics(t or "") for t in part.column(text_col).to_pylist()], np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), use(table)], names=[*names, name])

    return rows.mapInArrow(run, schema)


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, the text and ``features`` array<float> of every row."""
    def lists(table: np.ndarray) -> pa.Array:
        offsets = np.arange(0, table.size + 1, len(FEATURES), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))

    return _with_statistics(docs.select(*keep, text_col), text_col, lists, "features", "array<float>")


@dataclass
class Trees:
    """Flat trees: node i of tree t tests ``feature[t, i] <= cut[t, i]`` and goes to 2i + 1, else 2i + 2;
    leaves carry ``value`` and test nothing (feature -1)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, table: np.ndarray) -> np.ndarray:
        total = np.full(len(table), self.start)
        rows = np.arange(len(table))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(table), np.int64)
            for _ in range(self.depth):
                tested = feature[at]
                goes = np.where(table[rows, np.maximum(tested, 0)] <= cut[at], 2 * at + 1, 2 * at + 2)
                at = np.where(tested < 0, at, goes)
            total += value[at]
        return total

    def score(self, table: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(table)))


def boost(table: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1,
          bins: int = 64, smooth: float = 1.0, least: int = 3, rows_share: float = 0.7,
          seed: int = 7) -> Trees:
    """Gradient boosting of the logistic loss on binned columns, one histogram pass per level."""
    n, width = table.shape
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(table[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))
            for j in range(width)]
    binned = np.stack([np.searchsorted(c, table[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    slot = binned + np.arange(width) * bins
    prior = min(max(labels.mean(), 1e-4), 1 - 1e-4)
    start = float(np.log(prior / (1 - prior)))
    margin = np.full(n, start)
    nodes = 2 ** (depth + 1) - 1
    grown = [np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.float32), np.zeros((trees, nodes))]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        use = rng.random(n) < rows_share
        g, h = (labels - p) * use, p * (1 - p) * use
        at = np.zeros(n, np.int64)
        for level in range(depth + 1):
            first, count = 2 ** level - 1, 2 ** level
            inside = (at >= first) & use
            local = at[inside] - first
            gs = np.bincount(local, g[inside], count)
            hs = np.bincount(local, h[inside], count)
            grown[2][t, first:first + count] = rate * gs / (hs + smooth)
            if level == depth:
                break
            flat = (local[:, None] * (width * bins) + slot[inside]).ravel()
            size = count * width * bins
            sums = [np.bincount(flat, np.repeat(x[inside], width), size).reshape(count, width, bins).cumsum(axis=2)
                    for x in (g, h, use.astype(float))]
            gl, hl, cl = (x[:, :, :-1] for x in sums)
            gr, hr, cr = (x[:, :, -1:] - x[:, :, :-1] for x in sums)
            gain = gl ** 2 / (hl + smooth) + gr ** 2 / (hr + smooth) - (gs ** 2 / (hs + smooth))[:, None, None]
            limit = np.array([len(c) for c in cuts])
            gain = np.where((cl >= least) & (cr >= least) & (np.arange(bins - 1) < limit[:, None]), gain, -1.0)
            best = gain.reshape(count, -1).argmax(axis=1)
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            which, bin_no = best // (bins - 1), best % (bins - 1)
            for i in np.nonzero(split)[0]:
                grown[0][t, first + i] = which[i]
                grown[1][t, first + i] = cuts[which[i]][bin_no[i]]
            node = at - first
            move = (at >= first) & split[np.clip(node, 0, count - 1)]
            safe = np.clip(node, 0, count - 1)
            right = binned[np.arange(n), which[safe]] > bin_no[safe]
            at = np.where(move, 2 * at + 1 + right, at)
        margin += grown[2][t][at]
    return Trees(*grown, start, depth)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = 40_000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", **how) -> Trees | None:
    """Trees from at most ``most_rows`` labels, those whose ids hash smallest, and the texts of their documents
    for which ``held_out`` is not true.  None where no labelled document is left."""
    marks = labels.where(labels[label_col].isin(0, 1)).select(
        labels[id_col].cast("long").alias("id"), labels[label_col].cast("double").alias("label"))
    marks = marks.where("id is not null").orderBy(F.xxhash64("id"), "id", "label").limit(most_rows)
    taught = docs.where(~F.coalesce(held_out, F.lit(False))).select(
        docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    known = taught.join(F.broadcast(marks), "id")  # most_rows rows of two numbers
    sample = features(known, ["id", "label"]).drop("text").orderBy("id", "label", "features").toPandas()
    if not len(sample):
        return None
    return boost(np.array(sample["features"].tolist(), np.float32), sample["label"].to_numpy(float), **how)


def scored(rows: DataFrame, trees: Trees | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``rows`` with ``score_col``; without trees every score is 0.5."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def score(table: np.ndarray) -> pa.Array:
        return pa.array(np.full(len(table), 0.5) if shared.value is None else shared.value.score(table))

    return _with_statistics(rows, text_col, score, score_col, "double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3,
             id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row of ``docs``, by trees from the labels.

    ``held_out`` is a condition on ``docs``; its true rows teach nothing.  A label other than 0 and 1, a
    null label and a null id teach nothing; repeated labels of an id count each.  A null or empty text is
    scored by its (zero) statistics, a null id keeps its row with ``held_out`` false.  No labels: 0.5.
    """
    trees = fit(docs, labels, held_out, id_col=id_col, text_col=text_col, **how)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       text_of(docs, text_col).alias("text"))
    return scored(rows, trees).select(
        F.col("id").alias(id_col), "held_out", "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; see ``classify``."""
    trees = fit(docs, labels, held_out, **how)
    return scored(docs, trees, score_col="__score").where(F.col("__score") >= threshold).select(*docs.columns)
