"""BPE encoding that encodes content-defined chunks shared across documents once.

A rolling hash of the last 32 bytes cuts every distinct text into chunks, so equal passages give equal
chunks wherever they stand.  A chunk met at two or more spots is encoded at one of them, its owner, and the
others take its ids by a join; what is not shared is encoded where it is.  Chunks end anywhere, even inside
a word.  A chunk's ids are kept for its words between its first and last white space only, with the bytes at
both ends; at a join these ends are put together and encoded again, across further chunks until a
white space ends the word, at which the ids agree exactly with those of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from costlake.llm import tokens
from costlake.llm.common import slices, text_of, written

#: ids -> the output columns of a document
Finish = Callable[[list[bytes], list[np.ndarray]], dict[str, list]]

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, np.uint32)
_PART = pa.struct([("no", pa.int32()), ("chunk", pa.binary()), ("role", pa.int8()), ("open", pa.bool_()),
                   ("head", pa.binary()), ("body", pa.binary()), ("tail", pa.binary())])
_PART_SQL = "struct<no:int,chunk:binary,role:tinyint,open:boolean,head:binary,body:binary,tail:binary>"
_ALONE, _OWNED, _TAKEN = 0, 1, 2


def chunk_ends(raw: bytes, bits: int = 11) -> list[int]:
    """Ends of the chunks of ``raw``, about ``2 ** bits`` bytes apart, always between characters."""
    n = len(raw)
    if n < 64:
        return [n]
    octets = np.frombuffer(raw, np.uint8)
    rolling = _GEAR[octets]
    for k in (1, 2, 4, 8, 16):  # after the last round: the sum of g[b[i - j]] << j over j < 32
        rolling[k:] += rolling[:-k] << np.uint32(k)
    found = np.nonzero(rolling[31:-1] >> np.uint32(32 - bits) == 0)[0] + 32
    found = found[(octets[found] & 0xC0) != 0x80]
    return [*found.tolist(), n]


def chunk_keys(raw: bytes, bits: int) -> list[bytes]:
    at, keys = 0, []
    for end in chunk_ends(raw, bits):
        keys.append(xxhash.xxh3_128_digest(raw[at:end]))
        at = end
    return keys


_SPACE = b" \t\n\r\x0b\x0c"


def ends_of(raw: bytes) -> tuple[bool, bytes, bytes, bytes]:
    """(open, head, inside, tail) of a chunk: open if it has no white space, and then all of it is the head."""
    whites = [raw.find(bytes([c])) for c in _SPACE]
    first = min((i for i in whites if i >= 0), default=-1)
    if first < 0:
        return True, raw, b"", b""
    last = max(raw.rfind(bytes([c])) for c in _SPACE)
    return False, raw[:first], raw[first:last + 1], raw[last + 1:]


def join_parts(parts: list[dict], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """The ids of a text from its parts in order; words that a join cuts are encoded anew.

    A part is its head, its ids and its tail; a text's words at both ends are joins with nothing."""
    cut_words: list[bytes] = []
    pieces: list[bytes | None] = []
    carried = b""
    for part in parts:
        carried += part["head"]
        if part["open"]:
            continue
        cut_words.append(carried)
        pieces += [None, part["body"]]
        carried = part["tail"]
    cut_words.append(carried)
    pieces.append(None)
    ids = iter(encode([w.decode("utf-8", "replace") for w in cut_words]))
    return [next(ids) if p is None else p for p in pieces]


def encode_texts(docs: DataFrame, path: str, finish: Finish, finish_schema: str, chunk_bits: int = 11,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the columns of ``finish_schema``) of every row; ``path`` names a tokenizer that drops white space.

    ``finish`` gets, for some texts, the parts of their ids and the ids themselves.  A null text is empty,
    repeated rows and null ids keep their rows, equal texts are encoded once.
    """
    base = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    base = base.withColumn("text_key", F.unhex(F.md5("text")))
    fields = [f.strip().split(" ", 1) for f in finish_schema.split(",")]
    names = [n for n, _ in fields]

    def find_chunks(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                keys = [chunk_keys(t.encode("utf-8", "replace"), chunk_bits) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(keys, pa.list_(pa.binary()))],
                    names=["id", "text_key", "chunks"])

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                small = [pack(t.encode("utf-8", "replace")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(small, pa.binary())],
                    names=["id", "text_key", "text"])

    rows = written(base.mapInArrow(find_chunks, "id long, text_key binary, chunks array<binary>"), "chunks")
    texts = rows.groupBy("text_key").agg(F.min("id").alias("keeper"), F.first("chunks").alias("chunks"))
    spots = written(texts.select("text_key", "keeper", F.posexplode("chunks").alias("no", "chunk")), "spots")
    shared = (spots.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "no")).alias("own"))
              .where("n > 1").drop("n"))
    roles = spots.join(shared, "chunk").select("text_key", F.struct("no", "chunk", F.when(
        (F.col("text_key") == F.col("own.text_key")) & (F.col("no") == F.col("own.no")), _OWNED)
        .otherwise(_TAKEN).cast("tinyint").alias("role")).alias("role"))
    marks = roles.groupBy("text_key").agg(F.collect_list("role").alias("roles"))
    keepers = texts.select("text_key", "keeper").join(marks, "text_key", "left").withColumnRenamed("text_key", "key")
    small = base.mapInArrow(compress, "id long, text_key binary, text binary")  # as it moves once, whole
    # a text's keeper is one id, so rows that repeat lie where the join put them and need no second move of texts
    lowest = F.lit(-2**63).cast("long")
    keepers = keepers.withColumn("keeper", F.coalesce("keeper", lowest))
    small = small.withColumn("holder", F.coalesce("id", lowest))
    held = small.join(keepers, (small.text_key == keepers.key) & (small.holder == keepers.keeper))
    chosen = held.groupBy("text_key", "holder").agg(F.first("text").alias("text"), F.first("roles").alias("roles"))

    def encode(batches):
        own = tokens.encoder(path, "dropped")
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keys, whole, split = [], [], []
                for key, small, roles in zip(*(part.column(c).to_pylist() for c in ("text_key", "text", "roles"))):
                    raw = unpack(small)
                    if roles:
                        split.append((key, raw, {r["no"]: r for r in roles}))
                    else:
                        keys.append(key)
                        whole.append(raw.decode())
                raws = own.encode(whole)
                out = finish([[r] for r in raws], [np.frombuffer(r, own.dtype) for r in raws])
                none = [None] * len(split)
                made, insides = [], []
                for _, raw, roles in split:
                    parts, at, run = [], 0, None
                    for no, end in enumerate(chunk_ends(raw, chunk_bits)):
                        mark = roles.get(no)
                        if mark is None:
                            if run is None:
                                run = dict(no=no, chunk=None, role=_ALONE, raw=b"")
                                parts.append(run)
                            run["raw"] += raw[at:end]
                        else:
                            run = None
                            parts.append(dict(no=no, chunk=mark["chunk"], role=mark["role"], raw=raw[at:end]))
                        at = end
                    for p in parts:
                        if p["role"] != _TAKEN:
                            p["open"], p["head"], inside, p["tail"] = ends_of(p["raw"])
                            insides.append(inside.decode("utf-8", "replace"))
                        del p["raw"]
                    made.append(parts)
                bodies = iter(own.encode(insides))
                for parts in made:
                    for p in parts:
                        if p["role"] != _TAKEN:
                            p["body"] = next(bodies)
                columns = [pa.array(keys + [s[0] for s in split], pa.binary()),
                           pa.array([None] * len(keys) + made, pa.list_(_PART))]
                columns += [_column(kind, [*out[n], *none]) for n, kind in fields]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "parts", *names])

    encoded = written(chosen.mapInArrow(
        encode, f"text_key binary, parts array<{_PART_SQL}>, {finish_schema}"), "encoded")
    parts = encoded.where("parts is not null").select("text_key", F.explode("parts").alias("part"))
    lent = parts.where(F.col("part.role") == _OWNED).select("part.chunk", F.col("part").alias("lent"))
    lent = lent.groupBy("chunk").agg(F.first("lent").alias("lent"))
    taken = parts.where(F.col("part.role") == _TAKEN).select("text_key", "part.chunk", "part.no")
    filled = taken.join(lent, "chunk").select("text_key", F.struct(
        "no", "lent.open", "lent.head", "lent.body", "lent.tail").alias("part"))
    kept = parts.where(F.col("part.role") != _TAKEN).select("text_key", F.struct(
        "part.no", "part.open", "part.head", "part.body", "part.tail").alias("part"))
    whole = kept.unionByName(filled).groupBy("text_key").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def assemble(batches):
        own = tokens.encoder(path, "dropped")
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                joined = [join_parts(p, own.encode) for p in some.column("parts").to_pylist()]
                out = finish(joined, [np.frombuffer(b"".join(j), own.dtype) for j in joined])
                yield pa.RecordBatch.from_arrays(
                    [some.column("text_key"), *(_column(kind, out[n]) for n, kind in fields)], names=["text_key", *names])

    results = encoded.where("parts is null").select("text_key", *names).unionByName(
        whole.mapInArrow(assemble, f"text_key binary, {finish_schema}"))
    results = written(results.groupBy("text_key").agg(*[F.first(n).alias(n) for n in names]), "results")
    return rows.select(F.col("id").alias(id_col), "text_key").join(results, "text_key").drop("text_key")


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _column(kind: str, values: list) -> pa.Array:
    return pa.array(values, _ARROW[kind])


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """UTF-8 of the tokens as the vocabulary writes them, joined by blanks, as of a file without a decoder."""
    texts = tokens.token_texts(path, "dropped")
    return b" ".join([texts[i] for i in ids.tolist()])


def real_output(path: str) -> tuple[Finish, str]:
    """``ids`` and ``decoded`` of each text."""

    def finish(_, ids):
        return {"ids": [i.tolist() for i in ids], "decoded": [decode_ids(path, i).decode() for i in ids]}

    return finish, "ids array<int>, decoded string"
