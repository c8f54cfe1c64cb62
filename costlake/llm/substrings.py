"""Removal of byte strings that an earlier document has, by merged Burrows-Wheeler transforms.

Two documents can share a window of ``width`` bytes only where they share its minimizer, the smallest hash
of the strings of half that width in it.  So the text falls into runs of windows with one minimizer, and

1. texts are put in blocks of a few MB; each block says which minimizers it has, once each, and which of
   them two of its documents have; those met in two blocks or two documents are shared;
2. each block names the strings under shared minimizers, equal strings once, with their smallest document;
   equal names of all blocks become one, which is how copies and common lines shrink;
3. a string alone under its minimizer shares windows with no other.  The rest are read by one block each and meet
   by minimizer; transforms of shards of them are merged (``suffixes``), whose blocks at depth
   ``width`` are the classes of equal windows, and every window learns its smallest document;
4. each block marks the bytes under windows whose smallest document is smaller than its own.

Minimizers with very many strings are split: their windows meet by their own hashes, in a plain grouping.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from costlake.llm.common import discard, text_of, written
from costlake.llm.suffixes import smallest_owner

_LATEST = np.iinfo(np.int64).max  # a null id comes after all others
_BYTE = np.random.default_rng(10).integers(0, 2**64, 256, np.uint64)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def block_rows(docs: DataFrame, block_bytes: int, id_col: str, text_col: str, tag_col: str | None) -> DataFrame:
    """(``block``, ``ids``, ``tags``, ``sizes``, ``payload``): whole texts in runs of about ``block_bytes``, compressed."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=5)
        ids, tags, raws, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([[_LATEST if i is None else i for i in ids]], pa.list_(pa.int64())),
                 pa.array(["".join("\n" if t is None else f"{t}\n" for t in tags)], pa.string()),
                 pa.array([[len(r) for r in raws]], pa.list_(pa.int64())),
                 pa.array([pack.compress(b"".join(raws))], pa.binary())], names=["ids", "tags", "sizes", "payload"])

        for batch in batches:
            for doc_id, tag, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text"))):
                ids.append(doc_id)
                tags.append(tag)
                raws.append(text.encode("utf-8", "replace"))
                held += len(raws[-1]) + 16
                if held >= block_bytes:
                    yield row()
                    ids, tags, raws, held = [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[tag_col or id_col].cast("string").alias("tag"),
                       text_of(docs, text_col).alias("text"))
    made = rows.mapInArrow(run, "ids array<long>, tags string, sizes array<long>, payload binary")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def gram_of(width: int) -> int:
    """The length of the strings whose least hash is a window's minimizer: half the window, 16 to 32 bytes.

    Shorter ones are shared by chance, by documents that share no window; longer ones cut the texts into more runs."""
    return min(32, max(16, width // 2))


def minimizers(octets: np.ndarray, width: int) -> np.ndarray:
    """The minimizer of every window start; needs ``width`` bytes at least, and 16."""
    gram = gram_of(width)
    h = _BYTE[octets]
    for k, mul in zip((1, 2, 4, 8), _MUL):
        h = h[:-k] * mul + h[k:]
    if gram > 16:
        h = h[:16 - gram] * _MUL[1] + h[gram - 16:]
    h ^= h >> np.uint64(32)
    h *= _MUL[0]
    h ^= h >> np.uint64(29)
    grams = width - gram + 1
    k = 1
    while 2 * k <= grams:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    if k < grams:
        h = np.minimum(h[:k - grams], h[grams - k:])
    return h


def runs_of(raws: list[bytes], width: int, step: int = 1 << 18):
    """(text number, first window, end window, minimizer) arrays of the runs of windows with one minimizer."""
    found = []
    at = 0
    while at < len(raws):
        upto, held = at, 0
        while upto < len(raws) and (upto == at or held < step):
            held += len(raws[upto])
            upto += 1
        sizes = np.array([len(r) for r in raws[at:upto]], np.int64)
        octets = np.frombuffer(b"".join(raws[at:upto]), np.uint8)
        if len(octets) >= width:
            least = minimizers(octets, width)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            across = np.zeros(len(octets) + 1, bool)  # windows that reach over the end of their text
            for less in range(1, width):
                across[np.maximum(ends - less, begins)] |= less <= sizes
            inside = ~across[:len(least)]
            edge = np.ones(len(least), bool)
            np.not_equal(least[1:], least[:-1], out=edge[1:])
            edge[begins[begins < len(least)]] = True
            first = np.nonzero(edge & inside)[0]
            edge[1:] |= across[1:len(least)]
            stop = np.nonzero(np.append(edge[1:], True) & inside)[0] + 1
            of = np.searchsorted(begins, first, side="right") - 1
            found.append((of + at, first - begins[of], stop - begins[of], least[first]))
        at = upto
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def texts_in(sizes: np.ndarray, payload: bytes) -> list[bytes]:
    joined = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def anchors(key: np.ndarray, buckets: int) -> np.ndarray:
    """The short name of minimizers: their bucket and 32 more bits.  Two that share it only meet in vain."""
    return ((key % np.uint64(buckets)) << np.uint64(32) | key >> np.uint64(32)).view(np.int64)


def shared_minimizers(blocks: DataFrame, width: int, buckets: int) -> DataFrame:
    """(``block``, ``bucket``, ``keys`` binary of 32-bit names): those that two documents have."""
    def cells(batches):
        for batch in batches:
            for no, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "payload"))):
                text, _, _, key = runs_of(texts_in(sizes, payload), width)
                key = anchors(key, buckets)
                order = np.argsort(key)
                key, text = key[order], text[order]
                cut = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
                many = np.zeros(0, bool)
                if len(cut):
                    many = np.minimum.reduceat(text, cut) < np.maximum.reduceat(text, cut)
                key = key[cut]
                bucket, short = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(b, slice(edges[b], edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([no] * len(rows), pa.int64()),
                     pa.array([short[r].tobytes() for _, r in rows], pa.binary()),
                     pa.array([np.packbits(many[r]).tobytes() for _, r in rows], pa.binary())],
                    names=["bucket", "block", "keys", "many"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(pdf["many"], parts)])
        key = np.concatenate(parts)
        order = np.argsort(key)
        twin = key[order[1:]] == key[order[:-1]]
        shared = many.astype(bool)
        shared[order[1:]] |= twin
        shared[order[:-1]] |= twin
        ends = np.cumsum([len(p) for p in parts])
        some = [(int(b), p[shared[end - len(p):end]].tobytes()) for b, p, end in zip(pdf["block"], parts, ends)]
        some = [(b, k) for b, k in some if k]
        return pd.DataFrame({"block": np.array([b for b, _ in some], np.int64), "bucket": np.full(
            len(some), pdf["bucket"].iloc[0], np.int32), "keys": [k for _, k in some]})

    cell_rows = blocks.select("block", "sizes", "payload").mapInArrow(
        cells, "bucket int, block long, keys binary, many binary")
    return cell_rows.groupBy("bucket").applyInPandas(meet, "block long, bucket int, keys binary")


def _occurrences(block: pd.DataFrame, width: int, buckets: int, wanted: np.ndarray):
    """(ids, texts, text number, first window, end window, anchor, name) of the runs under ``wanted`` anchors."""
    ids = np.array(block["ids"].iloc[0], np.int64)
    raws = texts_in(block["sizes"].iloc[0], block["payload"].iloc[0])
    text, first, stop, key = runs_of(raws, width)
    key, wanted = anchors(key, buckets), np.unique(wanted)
    if len(wanted) and len(key):
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        mine = np.nonzero(wanted[at] == key)[0]
    else:
        mine = np.zeros(0, np.int64)
    text, first, stop = text[mine], first[mine], stop[mine]
    name = xxhash.xxh3_64_intdigest  # a string's own name; equal strings have one anchor
    names = np.array([name(raws[t][a:b]) for t, a, b in zip(text.tolist(), first.tolist(), (stop + width - 1).tolist())],
                     np.uint64).view(np.int64)
    return ids, raws, text, first, stop, key[mine], names


def shared_strings(blocks: DataFrame, shared: DataFrame, width: int, buckets: int) -> DataFrame:
    """(``block``, ``anchor``, ``skey``, ``least``, ``most``): each block's distinct runs, their first and last id."""
    def strings(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ("block", "anchor", "skey", "least", "most")
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        wanted = np.concatenate([np.frombuffer(k, np.uint32).astype(np.int64) | (int(b) << 32)
                                 for b, k in zip(right["bucket"], right["keys"])])
        ids, _, text, _, _, anchor, names = _occurrences(left, width, buckets, wanted)
        order = np.argsort(names)
        anchor, names, owner = anchor[order], names[order], ids[text[order]]
        cut = np.nonzero(np.append(True, names[1:] != names[:-1]))[0] if len(names) else np.zeros(0, np.int64)
        some = len(cut) > 0
        return pd.DataFrame(dict(zip(columns, (
            np.full(len(cut), left["block"].iloc[0], np.int64), anchor[cut], names[cut],
            np.minimum.reduceat(owner, cut) if some else owner, np.maximum.reduceat(owner, cut) if some else owner))))

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(
        strings, "block long, anchor long, skey long, least long, most long")


def string_bytes(blocks: DataFrame, lenders: DataFrame, width: int, buckets: int) -> DataFrame:
    """``lenders`` (block, anchor, skey, owner, last, n) with the bytes of each string, which its block knows."""
    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("anchor", "skey", "owner", "last", "n", "string")})
        right = right.sort_values("skey")
        skey = right["skey"].to_numpy(np.int64)
        _, raws, text, first, stop, _, names = _occurrences(left, width, buckets, right["anchor"].to_numpy(np.int64))
        at = np.minimum(np.searchsorted(skey, names), len(skey) - 1)
        met = np.nonzero(skey[at] == names)[0]
        row, one = np.unique(at[met], return_index=True)
        one = met[one]
        out = right.iloc[row][["anchor", "skey", "owner", "last", "n"]].reset_index(drop=True)
        return out.assign(string=[raws[t][a:b + width - 1] for t, a, b in zip(
            text[one].tolist(), first[one].tolist(), stop[one].tolist())])

    return blocks.groupBy("block").cogroup(lenders.groupBy("block")).applyInPandas(
        fetch, "anchor long, skey long, owner long, last long, n long, string binary")


def _owner_runs(least: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """(smallest owner, (window, owner) pairs in bytes) of strings with ``counts`` windows, whose owners ``least`` lists
    in turn: a pair for each window at which the owner changes, none where one has all windows."""
    begins = np.cumsum(counts) - counts
    edge = np.append(True, least[1:] != least[:-1])
    edge[begins] = True
    cut = np.nonzero(edge)[0]
    of = np.searchsorted(begins, cut, side="right") - 1
    pairs = np.column_stack([cut - begins[of], least[cut]]).astype(np.int64).tobytes()
    ends = 16 * np.cumsum(np.bincount(of, minlength=len(counts)))
    runs = [pairs[a:b] if b - a > 16 else None for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return np.minimum.reduceat(least, begins), runs


def window_owners(strings: DataFrame, width: int, bucket_bytes: int, hot: int) -> DataFrame:
    """(``anchor``, ``skey``, ``owner``, ``runs``) of strings (anchor, skey, owner, last, n, string): the smallest document
    that has a window of the string, and (``_owner_runs``) which document is the smallest for which windows.
    Strings without a window that the last of their documents would lose are left out.

    ``n`` is the number of strings under an anchor; above ``hot`` their windows meet by hash instead.
    """
    crowd = strings.where(F.col("n") <= hot)
    total = crowd.agg(F.sum(F.length("string"))).first()[0] or 0
    buckets = max(1, int(total // bucket_bytes) + 1)
    schema = "anchor long, skey long, owner long, runs binary"

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("anchor")
        least = smallest_owner(list(pdf["string"]), pdf["owner"].to_numpy(np.int64), width)
        lowest, runs = _owner_runs(np.concatenate(least), np.array([len(x) for x in least]))
        out = pd.DataFrame({"anchor": pdf["anchor"].to_numpy(), "skey": pdf["skey"].to_numpy(), "owner": lowest,
                            "runs": pd.Series(runs, dtype=object)})
        return out[lowest < pdf["last"].to_numpy()]

    def windows(batches):
        for batch in batches:
            for anchor, skey, string, owner, last in zip(
                    *(batch.column(c).to_pylist() for c in ("anchor", "skey", "string", "owner", "last"))):
                n = len(string) - width + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(string[i:i + width]) for i in range(n)], pa.binary()),
                     pa.array([anchor] * n, pa.int64()), pa.array([skey] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([owner] * n, pa.int64()), pa.array([last] * n, pa.int64())],
                    names=["window", "anchor", "skey", "no", "owner", "last"])

    def gathered(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("owners")
                lowest, runs = _owner_runs(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("skey"), pa.array(lowest, pa.int64()),
                                                  pa.array(runs, pa.binary())], names=["anchor", "skey", "owner", "runs"])

    settled = (crowd.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        merged, schema))
    spread = strings.where(F.col("n") > hot).select("anchor", "skey", "string", "owner", "last").mapInArrow(
        windows, "window binary, anchor long, skey long, no int, owner long, last long")
    lowest = spread.groupBy("window").agg(F.min("owner").alias("least"))
    split = spread.join(lowest, "window").groupBy("anchor", "skey").agg(
        F.array_sort(F.collect_list(F.struct("no", "least"))).alias("w"), F.max("last").alias("last")).where(
        F.array_min("w.least") < F.col("last")).select("anchor", "skey", F.col("w.least").alias("owners")).mapInArrow(
        gathered, schema)
    return settled.unionByName(split)


def mark(blocks: DataFrame, known: DataFrame, width: int, buckets: int, finish: Callable, schema: str, tagged: bool) -> DataFrame:
    """``finish(id, raw, keep mask)`` of every document; ``known`` has (block, anchor, skey, owner, runs) as
    ``window_owners`` says."""
    fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]
    names = [n for n, _ in fields]

    def marked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        ids, raws, text, first, stop, _, names = _occurrences(left, width, buckets, right["anchor"].to_numpy(np.int64))
        begins = np.cumsum([0, *map(len, raws)])
        edges = np.zeros(begins[-1] + 1, np.int32)
        if len(right):
            right = right.sort_values("skey")
            skey = right["skey"].to_numpy(np.int64)
            at = np.minimum(np.searchsorted(skey, names), len(skey) - 1)
            met = skey[at] == names
            at, text, first, stop = at[met], text[met], first[met], stop[met]
            runs = [x if x is not None else b"" for x in right["runs"]]
            sizes = np.array([len(x) // 16 for x in runs])
            pairs = np.frombuffer(b"".join(runs), np.int64).reshape(-1, 2)
            whole = (sizes[at] == 0) & (right["owner"].to_numpy(np.int64)[at] < ids[text])  # one owner of all windows
            count = sizes[at]
            no = np.repeat(np.arange(len(at)), count)  # the others, pair by pair
            ends = np.cumsum(count)
            pair = np.arange(len(no)) + np.repeat(np.cumsum(sizes)[at] - ends, count)
            begun, owner = pairs[pair, 0], pairs[pair, 1]
            upto = np.append(begun[1:], 0)
            upto[ends[count > 0] - 1] = (stop - first)[count > 0]
            late = owner < ids[text[no]]
            base = begins[text] + first
            np.add.at(edges, np.concatenate([base[whole], (base[no] + begun)[late]]), 1)
            np.add.at(edges, np.concatenate([(begins[text] + stop)[whole], (base[no] + upto)[late]]) + width - 1, -1)
        kept = np.cumsum(edges[:-1]) == 0
        rows, tags = [], left["tags"].iloc[0].split("\n")
        for no, raw in enumerate(raws):
            keep = kept[begins[no]:begins[no + 1]]
            name = tags[no] if tagged else int(tags[no]) if tags[no] else None
            rows.append(finish(name, raw, keep))
        columns = zip(*rows) if rows else [()] * len(names)
        return pd.DataFrame({n: pd.array(list(c), "Int64") if kind == "long" else list(c)
                             for (n, kind), c in zip(fields, columns)})

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(marked, schema)


def without(raw: bytes, keep: np.ndarray) -> str:
    """The text of the kept bytes; a character that loses a byte goes whole."""
    if keep.all():
        return raw.decode("utf-8", "replace")
    octets = np.frombuffer(raw, np.uint8)
    char = np.cumsum((octets & 0xC0) != 0x80) - 1
    whole = np.ones(char[-1] + 1, bool)
    whole[char[~keep]] = False
    return octets[whole[char]].tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, finish: Callable, schema: str, width: int = 50, block_bytes: int = 4 << 20,
                   bucket_bytes: int = 1 << 20, hot: int = 20_000, id_col: str = "doc_id",
                   text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """One row per document: ``finish(id, text in bytes, mask of kept bytes)`` as ``schema`` says.

    With ``tag_col``, a text column without line ends, ``finish`` gets its value instead of the id.

    A byte is removed if it lies in a ``width``-byte string that also starts in a document with a smaller id, as
    the input is.  Null texts are empty.  Rows of one id do not remove each other's bytes; a null id comes after
    all others.  An empty table gives none.
    """
    blocks = block_rows(docs, block_bytes, id_col, text_col, tag_col)
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(4, int(size // (16 << 20)) + 1)
    shared = shared_minimizers(blocks, width, buckets)
    found = written(shared_strings(blocks, shared, width, buckets), "strings")
    names = found.groupBy("anchor", "skey").agg(
        F.min("least").alias("owner"), F.max("most").alias("last"), F.min("block").alias("lender"))
    named = written(names.join(names.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchor"), "names")
    lenders = named.where("n > 1").select(F.col("lender").alias("block"), "anchor", "skey", "owner", "last", "n")
    lent = written(string_bytes(blocks, lenders, width, buckets), "bytes")
    owners = written(window_owners(lent, width, bucket_bytes, hot), "owners")
    discard(lent)
    alone = named.where("n = 1 and owner < last").select("anchor", "skey", "owner", F.lit(None).cast("binary").alias("runs"))
    known = found.select("block", "anchor", "skey", "most").join(
        owners.unionByName(alone), ["anchor", "skey"]).where("owner < most").drop("most")
    return mark(blocks, known, width, buckets, finish, schema, tag_col is not None)
