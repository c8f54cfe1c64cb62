"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance ``r`` or less have a midpoint within ``r / 2`` of both.  So every
fingerprint emits all variants within half the radius, equal variants meet, and whoever meets is
verified by its distance.  The variants are shuffled by their leading bits: a fingerprint goes to each
prefix that half the radius of flips can reach, carrying nothing else, and the flips of the lower bits are
made where the variants meet, in bounded slices.  What meets on a variant is linked to its smallest
member, and each task keeps a spanning forest of its links, so that a group of g close fingerprints gives
at most g - 1 links per prefix instead of g * g pairs.  Components follow by alternating star steps.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import discard, slices, text_of, written

_BITS = 64
#: Whether the fingerprints at two lists of row numbers are near.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_hashes(text: str, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z change, \x20 and \x09-\x0D split
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1:])), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(_BITS, np.int64)
    for part in range(0, len(hashes), 65536):
        octets = hashes[part:part + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.nonzero(2 * ones > len(hashes))[0])


def fingerprint_of(text: str, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The majority bits of the shingles' XXH64 values; zero for a text without words."""
    return majority(shingle_hashes(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``fingerprint`` long, the 64 bits as a signed number) of every row, with the columns of ``carry``; a null
    text is empty.  Texts are hashed whole, a few MB of them at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                prints = [fingerprint_of(t, words_per_shingle) for t in part.column("text").to_pylist()]
                signed = np.array(prints, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(signed)], names=[*part.schema.names[1:], "fingerprint"])

    rows = docs.select(text_of(docs, text_col).alias("text"), docs[id_col].cast("long").alias(id_col),
                       *[docs[c] for c in carry])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, schema + ", fingerprint long")


def _reachable(prefix_bits: int, flips: int) -> list[tuple[int, int]]:
    """(pattern of flipped prefix bits, their number) of every pattern with up to ``flips`` flips."""
    return [(sum(1 << b for b in chosen), n) for n in range(flips + 1)
            for chosen in itertools.combinations(range(prefix_bits), n)]


@functools.lru_cache(maxsize=256)
def _masks(bits: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for n in range(flips + 1)
                     for chosen in itertools.combinations(range(bits), n)], np.uint64)


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links; every member is tied to the smallest of its tree."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(parent) if top(x) != x]


def _leaves(prints: np.ndarray, spent: np.ndarray, low_bits: int, half: int,
            most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants, row numbers of their owners) in parts of at most ``most``; equal variants share a part.

    A part whose counted variants are too many is halved by its next bit: a row goes to the side of its own
    bit, and for one more flip to the other.  With no bit left all variants of a part are the same one.
    """
    reach = [[sum(math.comb(bits, n) for n in range(flips + 1)) for flips in range(half + 1)]
             for bits in range(low_bits + 1)]
    parts = [(np.arange(len(prints), dtype=np.int32), np.asarray(spent, np.int8), low_bits)]
    while parts:
        rows, used, bits = parts.pop()
        if len(rows) < 2:
            continue
        numbers = np.bincount(used, minlength=half + 1)
        if bits and sum(int(n) * reach[bits][half - s] for s, n in enumerate(numbers)) > most:
            own = (prints[rows] >> np.uint64(bits - 1)) & np.uint64(1) == 1
            for other in (own, ~own):
                cost = used + other.astype(np.int8)
                stays = cost <= half
                parts.append((rows[stays], cost[stays], bits - 1))
            continue
        low = np.uint64((1 << bits) - 1)
        variants, owners = [], []
        for s in np.nonzero(numbers)[0].tolist():
            masks, chosen = _masks(bits, half - s), rows[used == s]
            variants.append(((prints[chosen] & low)[:, None] ^ masks).ravel())
            owners.append(np.repeat(chosen, len(masks)))
        yield np.concatenate(variants), np.concatenate(owners)


def meet(prints: np.ndarray, spent: np.ndarray, low_bits: int, half: int, near: Near, labels: np.ndarray,
         most: int = 1_500_000) -> list[tuple[int, int]]:
    """Links, by ``labels``, among fingerprints that were sent to one prefix after ``spent`` flips of it.

    Neighbours in the order of the variants that have the same one are verified by ``near`` of their row
    numbers: all pairs are connected if all owners of a variant are near each other.
    """
    links: list[tuple[int, int]] = []
    for variants, owners in _leaves(prints, spent, low_bits, half, most):
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        equal = variants[1:] == variants[:-1]
        left, right = owners[1:][equal], owners[:-1][equal]
        good = near(left, right)
        if good.any():
            pairs = np.unique(np.stack([labels[left[good]], labels[right[good]]], axis=1), axis=0)
            links.extend(_forest(pairs[:, 0], pairs[:, 1]))
            if len(links) > 500_000:
                links = _forest(*np.array(links, labels.dtype).T)
    return _forest(*np.array(links, labels.dtype).T) if links else []


def prefix_bits_for(n: int, per_prefix: int = 1024) -> int:
    """Leading bits so that about ``per_prefix`` fingerprints share a prefix before any flip."""
    bits = 2
    while (n >> bits) > per_prefix and bits < 20:
        bits += 1
    return bits


def _hot(sent: DataFrame, keys: list[str], most_rows: int) -> tuple[Column | None, int]:
    """(Whether a row lies in a group of more than ``most_rows`` rows, the rows of the largest such group).

    Groups are named by a hash: one that shares it is taken for hot too, which only splits it.
    """
    found = sent.groupBy(F.xxhash64(*keys).alias("key")).count().where(F.col("count") > most_rows).collect()
    if not found:
        return None, 0
    return F.xxhash64(*keys).isin([r["key"] for r in found]), max(r["count"] for r in found)


def _split_by_bits(sent: DataFrame, low_bits: int, half: int, most_rows: int, step: int = 4) -> DataFrame:
    """``sent`` with ``low``, the bits below the prefix; prefixes of too many rows are lengthened by ``step`` bits.

    A fingerprint goes on to each longer prefix that its unspent flips reach.  Distinct fingerprints share a
    single variant in bounded number, so a group does not grow with a cluster.
    """
    settled, level = [], sent.withColumn("low", F.lit(low_bits))
    while low_bits:
        hot, _ = _hot(level, ["prefix"], most_rows)
        if hot is None:
            break
        settled.append(level.where(~hot))
        step = min(step, low_bits)
        low_bits -= step
        more = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).alias("n"))
                         for p, n in _reachable(step, min(half, step))])
        bits = F.shiftrightunsigned("fingerprint", low_bits).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        level = written(level.where(hot).select("fingerprint", "spent", "prefix", F.explode(more).alias("to"))
                        .where(F.col("spent") + F.col("to.n") <= half)
                        .select("fingerprint", (F.col("spent") + F.col("to.n")).alias("spent"),
                                F.shiftleft("prefix", step).bitwiseOR(bits.bitwiseXOR(F.col("to.p"))).alias("prefix"),
                                F.lit(low_bits).alias("low")), "longer")
    for part in settled:
        level = level.unionByName(part)
    return level


def ball_links(prints: DataFrame, radius: int = 4, prefix_bits: int | None = None,
               most_rows: int = 400_000) -> DataFrame:
    """(``a``, ``b``) links between distinct fingerprints that connect exactly those within ``radius``.

    ``prints`` has a long column ``fingerprint``; nulls are ignored.  Links are a forest per
    prefix, not every pair; the connected components equal those of all pairs.
    """
    half = (radius + 1) // 2
    distinct = written(prints.where("fingerprint is not null").select("fingerprint").distinct(), "prints")
    bits = prefix_bits if prefix_bits is not None else prefix_bits_for(distinct.count())
    low_bits = _BITS - bits
    patterns = F.array(*[F.struct(F.lit(p).cast("int").alias("p"), F.lit(n).cast("int").alias("spent"))
                         for p, n in _reachable(bits, min(half, bits))])
    sent = distinct.select("fingerprint", F.explode(patterns).alias("to")).select(
        "fingerprint", F.col("to.spent").alias("spent"),
        F.shiftrightunsigned("fingerprint", low_bits).bitwiseXOR(F.col("to.p").cast("long")).alias("prefix"),
    )
    sent = _split_by_bits(sent, low_bits, half, most_rows)

    def collide(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
        found = meet(prints, pdf["spent"].to_numpy(), int(pdf["low"].iloc[0]), half,
                     lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= radius, prints)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return sent.groupBy("low", "prefix").applyInPandas(collide, "a long, b long").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) of every linked node by alternating large-star and small-star steps.

    Each step ties nodes to the smallest node that they know; a step that changes nothing ends it.
    Stars grow by joins on the minimum, never by collecting a neighbourhood.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select("v", "m").where("v <> m").toDF("u", "v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        fresh = written(small, "links")
        discard(edges)
        # a star of stars: every node has one neighbour below it, and that is no one's upper node
        again = fresh.groupBy("u").count().where("count > 1").limit(1)
        chained = fresh.select(F.col("v").alias("u")).distinct().join(fresh.select("u"), "u", "left_semi").limit(1)
        edges = fresh
        if again.isEmpty() and chained.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id",
                text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns of ``carry``, ``fingerprint`` (long), ``component_id`` and ``is_first``.

    A text without words has fingerprint zero and links like any other.  Equal fingerprints are one
    node; a component's id is the smallest non-null id in it.  ``is_first`` marks its rows with that id (with the least
    carried values, too, so exactly one row if these tell rows apart); a component of null ids alone has a
    first row all the same.  Rows that repeat stay repeated; a row with a null id has a fingerprint and the
    component of its fingerprint.  An empty table gives none.
    """
    prints = written(fingerprints(docs, words_per_shingle, id_col, text_col, carry), "fingerprints")
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), *carry)
    least = prints.groupBy("fingerprint").agg(F.min(order).alias("least"))
    roots = components(ball_links(prints, radius))
    placed = least.join(roots, least.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("first"))
    of = placed.join(named, "root").select("fingerprint", "first")
    return prints.join(of, "fingerprint").select(
        id_col, *carry, "fingerprint", F.col("first.id").alias("component_id"), (order == F.col("first")).alias("is_first"))


def near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, ``fingerprint`` long, ``component_id``) of every row of ``near_groups``."""
    return near_groups(docs, radius, words_per_shingle, id_col, text_col).select(id_col, "fingerprint", "component_id")
