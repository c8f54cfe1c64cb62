"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the same bytes.  Where tokens of both end, the text falls into groups; every stretch between
two neighbouring ends of either is the overlap of one token of each, which is a link.  So the links of a text
follow from the union of the two lists of ends.

Tasks number their documents in blocks and turn the links of a block into postings: for every pair of ids a
compressed bitmap of the documents that hold it (sorted 16-bit numbers, or 65,536 bits where those are
shorter), and, where a document holds it more than once, one such bitmap for every binary digit of the
multiplicity.  Bitmaps of a block's chunks are OR-merged before they are written.  Popcounts summed over blocks are
a pair's documents, popcounts weighted by digit its links.  To score documents only (block, pair) keys
travel: a block's postings meet the counts of its pairs and hand them back to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import text_of, written
from costlake.llm.tokens import Encoder

_SLOTS = 65_536  # documents in a block
_DENSE = 8_192  # bytes of a bitmap; longer lists of numbers than that become one
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_LOADED: dict = {}

_DOC = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_ROW = ("block long, slot int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair long, docs binary, planes array<binary>")


class _Plain(Encoder):
    """Ids of texts that begin with a blank; strings of special tokens are ordinary text."""

    def __init__(self, path: str, ranks: str | None):
        super().__init__(path, "leading", ranks)
        self.tokenizer.encode_special_tokens = True

    @staticmethod
    def _ends_visible(word: bytes) -> bool:
        return not word or Encoder._ends_visible(word)


class Pair:
    """The two tokenizers of a worker, with the bytes behind every id."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None):
        import sentencepiece

        self.a = _Plain(path_a, ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = _byte_alphabet()
        tokens = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.size)]
        self.bytes_a = [bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode() for t in tokens]
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size_b)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.width = max(self.a.size, self.size_b)
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.width)]

    def encode(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids by A of each piece, ids by B of it without its first blank, which B adds)."""
        by_a = [np.frombuffer(x, self.a.dtype).astype(np.int64) for x in self.a.encode(pieces)]
        by_b = [np.array(x, np.int64) for x in self.b.encode([p[1:] for p in pieces], num_threads=1)]
        return by_a, by_b


def _byte_alphabet() -> dict[str, int]:
    """Byte of every character of a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizers_of(path_a: str, path_b: str, ranks: str | None) -> Pair:
    key = (path_a, path_b, ranks)
    if key not in _LOADED:
        _LOADED[key] = Pair(*key)
    return _LOADED[key]


def pieces_of(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text with a blank in front, cut before single blanks between visible ASCII characters, where both
    tokenizers cut too; pieces have about ``most`` characters, more where such a blank is far."""
    text, begun = " " + text, 0
    while len(text) - begun > most:
        cut = _CUT.search(text, begun + most)
        if cut is None:
            break
        yield text[begun:cut.start()]
        begun = cut.start()
    yield text[begun:] if begun else text


class Aligned:
    """Links and groups of several pieces at once, all of which both tokenizers reproduce."""

    def __init__(self, pair: Pair, by_a: list[np.ndarray], by_b: list[np.ndarray]):
        self.n_a = np.array([len(x) for x in by_a], np.int64)
        self.n_b = np.array([len(x) for x in by_b], np.int64)
        a, b = np.concatenate(by_a), np.concatenate(by_b)
        ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
        last = ends_a[np.cumsum(self.n_a) - 1]  # every piece ends with a token of both
        cuts = np.union1d(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.of = np.searchsorted(last, cuts)  # the piece of every link
        self.n_links = np.bincount(self.of, minlength=len(by_a))
        self.n_groups = np.bincount(np.searchsorted(last, both), minlength=len(by_a))
        self.code = a[np.searchsorted(ends_a, cuts)] * pair.size_b + b[np.searchsorted(ends_b, cuts)]
        self.names = pair.names
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        upto_a = np.searchsorted(ends_a, both, "right")
        upto_b = np.append(0, np.searchsorted(ends_b, both, "right"))
        self.order = np.empty(len(a) + len(b), np.int64)
        self.order[np.arange(len(a)) + upto_b[group_a]] = a + pair.width * (both[group_a] == ends_a)
        self.order[np.arange(len(b)) + upto_a[group_b]] = b + 2 * pair.width * (both[group_b] == ends_b)
        self.begun = np.append(0, np.cumsum(self.n_a + self.n_b))

    def groups(self, i: int) -> str:
        """The groups of a piece as ``a1,a2|b1;a3|b2,b3``."""
        names = self.names
        return "".join([names[k] for k in self.order[self.begun[i]:self.begun[i + 1]].tolist()])[:-1]


def containers(groups: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the compressed bitmap of each of ``n`` groups; ``groups`` ascends, slots within too."""
    sizes = np.bincount(groups, minlength=n)
    dense = sizes * 2 >= _DENSE
    offsets = np.append(0, np.cumsum(np.where(dense, _DENSE, 2 * sizes)))
    data = np.zeros(offsets[-1], np.uint8)
    first = np.append(0, np.cumsum(sizes))
    few = ~dense[groups]
    at = offsets[groups[few]] // 2 + np.nonzero(few)[0] - first[groups[few]]
    data.view("<u2")[at] = slots[few]
    for g in np.nonzero(dense)[0].tolist():
        bits = np.zeros(_SLOTS, np.uint8)
        bits[slots[first[g]:first[g + 1]]] = 1
        data[offsets[g]:offsets[g + 1]] = np.packbits(bits, bitorder="little")
    return offsets, data


def members(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, slot) of every set bit of compressed bitmaps."""
    flat = pa.concat_arrays([bitmaps]).cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    found = []
    few = np.nonzero((sizes > 0) & (sizes < _DENSE))[0]
    if len(few):
        n = sizes[few] // 2
        at = np.repeat(offsets[few] - (np.cumsum(n) - n) * 2, n) + 2 * np.arange(n.sum())
        found.append((np.repeat(few, n), data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8))
    for g in np.nonzero(sizes == _DENSE)[0].tolist():
        slots = np.nonzero(np.unpackbits(data[offsets[g]:offsets[g + 1]], bitorder="little"))[0]
        found.append((np.full(len(slots), g), slots))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class _Block:
    """The documents of one block, and their links as sorted numbers ``pair << 16 | slot`` with multiplicities."""

    def __init__(self, number: int):
        self.number, self.docs = number, []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> None:
        found, times = np.unique(codes, return_counts=True)
        self.codes.append(found)
        self.times.append(times)
        self.held += len(found)
        if self.held > 12_000_000:  # one endless document: its chunks have many pairs in common
            self.merge()

    def merge(self) -> None:
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
        first = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0]
        self.codes, self.times = [codes[first]], [np.add.reduceat(times, first)]
        self.held = len(first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*self.docs))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        docs = [pa.array(c, k) for c, k in zip(columns, kinds)]
        n = len(self.docs)
        yield _batch(self.number, n, pa.array(np.arange(n, dtype=np.int32)), dict(zip(_DOC, docs)))
        if not self.codes:
            return
        self.merge()
        codes, times = self.codes[0], self.times[0]
        pairs, of = np.unique(codes >> 16, return_inverse=True)
        slots = (codes & 0xFFFF).astype("<u2")
        first = np.searchsorted(of, np.arange(len(pairs)))
        digits = np.maximum.reduceat(times, first)
        digits = np.where(digits > 1, np.ceil(np.log2(digits + 1)).astype(np.int64), 0)
        step = max(1, (1 << 22) // (2 + 2 * len(codes) // len(pairs)))
        for low in range(0, len(pairs), step):  # parts of some MB
            high = min(low + step, len(pairs))
            mine = slice(first[low], first[high] if high < len(pairs) else len(codes))
            part, slot, time = of[mine] - low, slots[mine], times[mine]
            base = np.append(0, np.cumsum(digits[low:high]))
            planes = [(base[part[here]] + k, slot[here]) for k in range(int(digits[low:high].max(initial=0)))
                      for here in [(digits[low:high][part] > k) & (time >> k & 1 == 1)]]
            plane, seats = ((np.concatenate([p[0] for p in planes]), np.concatenate([p[1] for p in planes]))
                            if planes else (np.zeros(0, np.int64), np.zeros(0, "<u2")))
            order = np.argsort(plane, kind="stable")
            listed = pa.ListArray.from_arrays(
                pa.array(base.astype(np.int32)), _binary(*containers(plane[order], seats[order], int(base[-1]))))
            yield _batch(self.number, high - low, None, {
                "pair": pa.array(pairs[low:high]), "docs": _binary(*containers(part, slot, high - low)),
                "planes": listed})


_ARROW = {"block": pa.int64(), "slot": pa.int32(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
          "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pair": pa.int64(),
          "docs": pa.binary(), "planes": pa.list_(pa.binary())}


def _batch(block: int, n: int, slot: pa.Array | None, filled: dict[str, pa.Array]) -> pa.RecordBatch:
    filled = {"block": pa.array(np.full(n, block)), "slot": slot, **filled}
    arrays = [a if (a := filled.get(name)) is not None else pa.nulls(n, kind) for name, kind in _ARROW.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_ARROW))


class _Indexer:
    """Documents in, rows of blocks out; a chunk of a few MB is tokenized at a time."""

    def __init__(self, pair: Pair, task: int, most_postings: int, chunk: int):
        self.pair, self.most, self.chunk = pair, most_postings, chunk
        self.next_block = task << 32
        self.open_block()
        self.waiting: list[tuple[int, bool, str]] = []  # (slot, whether the document ends here, piece)
        self.size = 0
        self.state: dict[int, list] = {}

    def open_block(self) -> None:
        self.block = _Block(self.next_block)
        self.next_block += 1

    def put(self, doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
        if len(self.block.docs) == _SLOTS or self.block.held >= self.most:
            yield from self.close()
        slot = len(self.block.docs)
        self.block.docs.append([doc_id, 0, 0, 0, 0, ""])
        if not text:
            return
        self.state[slot] = [0, 0, 0, 0, sha256(), True, []]
        held = ""
        for piece in pieces_of(text):
            if held:
                self.wait(slot, False, held)
            held = piece
        self.wait(slot, True, held)

    def wait(self, slot: int, ends: bool, piece: str) -> None:
        self.waiting.append((slot, ends, piece))
        self.size += len(piece)
        if self.size >= self.chunk:
            self.work()

    def work(self) -> None:
        """Align what waits.  The links of a document wait for its last piece: they count only if all pieces are
        reproduced."""
        waiting, self.waiting, self.size = self.waiting, [], 0
        if not waiting:
            return
        pair = self.pair
        by_a, by_b = pair.encode([piece for _, _, piece in waiting])
        good = []
        for (slot, _, piece), a, b in zip(waiting, by_a, by_b):
            raw = piece.encode("utf-8", "replace")
            same = (b"".join([pair.bytes_a[i] for i in a.tolist()]) == raw
                    and b"".join([pair.bytes_b[i] for i in b.tolist()]) == raw)
            good.append(same)
            self.state[slot][5] &= same
        kept = [i for i, same in enumerate(good) if same and self.state[waiting[i][0]][5]]
        found = Aligned(pair, [by_a[i] for i in kept], [by_b[i] for i in kept]) if kept else None
        whole: list[np.ndarray] = []  # links of documents that lie in this chunk are joined at once
        at = dict(zip(kept, range(len(kept))))
        if found is not None:
            codes = found.code << 16 | np.array([waiting[i][0] for i in kept], np.int64)[found.of]
            edges = np.append(0, np.cumsum(found.n_links))
        for i, (slot, ends, _) in enumerate(waiting):
            state = self.state[slot]
            if i in at and state[5]:
                k = at[i]
                if state[0]:
                    state[4].update(b";")
                state[4].update(found.groups(k).encode())
                for n, value in enumerate((found.n_a[k], found.n_b[k], found.n_groups[k], found.n_links[k])):
                    state[n] += int(value)
                mine = codes[edges[k]:edges[k + 1]]
                state[6].append(mine if ends and not state[6] else np.unique(mine, return_counts=True))
            if ends:
                del self.state[slot]
                if state[5]:
                    self.block.docs[slot][1:] = [*state[:4], state[4].hexdigest()]
                    for part in state[6]:
                        if isinstance(part, tuple):
                            self.block.codes.append(part[0])
                            self.block.times.append(part[1])
                            self.block.held += len(part[0])
                        else:
                            whole.append(part)
        if whole:
            self.block.add(np.concatenate(whole))

    def close(self) -> Iterator[pa.RecordBatch]:
        self.work()
        if self.block.docs:
            yield from self.block.rows()
            self.open_block()


def postings(docs: DataFrame, path_a: str, path_b: str, ranks: str | None = None, id_col: str = "doc_id",
             text_col: str = "text", most_postings: int = 3_000_000, chunk: int = 2 << 20) -> DataFrame:
    """The written index: rows of documents (``slot`` set) and of pairs (``pair`` set: A id * pieces of B + B id)
    of every block.

    A block has at most 65,536 documents and about ``most_postings`` postings (one document may have more).
    Blocks are numbered by their task; as the table is written, numbers stay.
    """

    def run(batches):
        work = _Indexer(tokenizers_of(path_a, path_b, ranks), TaskContext.get().partitionId(), most_postings, chunk)
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                yield from work.put(doc_id, text.as_py())
        yield from work.close()

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return written(rows.mapInArrow(run, _ROW), "postings")


def popcount(bitmap: Column) -> Column:
    """The set bits of a compressed bitmap."""
    size = F.octet_length(bitmap)
    return F.when(size < _DENSE, (size / 2).cast("long")).otherwise(F.bitmap_count(bitmap))


def pair_counts(index: DataFrame) -> DataFrame:
    """(``pair``, ``n_docs``, ``n_links``) over all documents of an index."""
    digits = F.transform("planes", lambda p, k: F.call_function("shiftleft", popcount(p), k))
    times = F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s + x)
    links = F.when(F.size("planes") == 0, popcount(F.col("docs"))).otherwise(times)
    return index.where("pair is not null").groupBy("pair").agg(
        F.sum(popcount(F.col("docs"))).alias("n_docs"), F.sum(links).alias("n_links"))


def scored(index: DataFrame, counts: DataFrame, pieces_b: int) -> DataFrame:
    """One row per document of an index: its counts, ``n_best`` and ``count_sum``, returned by the postings."""
    best = counts.groupBy(F.expr(f"pair div {pieces_b}").alias("a")).agg(F.max("n_docs").alias("top"))
    rated = counts.withColumn("a", F.expr(f"pair div {pieces_b}")).join(best, "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("top")).cast("long").alias("best"))
    keys = index.where("pair is not null").select(F.col("block").alias("at"), F.col("pair").alias("link")).join(
        rated.withColumnRenamed("pair", "link"), "link")

    def give(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, known = rows.combine_chunks(), known.combine_chunks()
        is_doc = rows.column("slot").is_valid()
        docs, links = rows.filter(is_doc), rows.filter(rows.column("pair").is_valid())
        best, total = np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
        if links.num_rows:
            pair = known.column("link").to_numpy()
            order = np.argsort(pair)
            of = order[np.searchsorted(pair, links.column("pair").to_numpy(), sorter=order)]
            count, top = known.column("n_docs").to_numpy()[of], known.column("best").to_numpy()[of]
            planes = _one(links.column("planes"))
            n_planes = np.asarray(planes.value_lengths().fill_null(0))
            row, slot = members(_one(links.column("docs")))
            once = n_planes[row] == 0
            np.add.at(total, slot[once], count[row[once]])
            np.add.at(best, slot[once], top[row[once]])
            owner = np.repeat(np.arange(len(n_planes)), n_planes)
            digit = np.arange(len(owner)) - np.repeat(np.cumsum(n_planes) - n_planes, n_planes)
            row, slot = members(planes.flatten())
            np.add.at(total, slot, count[owner[row]] << digit[row])
            np.add.at(best, slot, top[owner[row]] << digit[row])
        at = docs.column("slot").to_numpy()
        return pa.table({**{name: docs.column(name) for name in _DOC},
                         "n_best": pa.array(best[at]), "count_sum": pa.array(total[at])})

    return index.groupBy("block").cogroup(keys.groupBy("at")).applyInArrow(
        give, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
              "count_sum long")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def align(docs: DataFrame, path_a: str, path_b: str, ranks: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the counts of every document, and (``a``, ``b``, ``n_docs``, ``n_links``) of every linked
    pair of ids.

    A is a byte-level file of the tokenizers library, which reads the text behind one blank; B a sentencepiece model
    that adds this blank itself; ``ranks`` names A's vocabulary for the quicker engine.  Texts that are null, empty
    or not reproduced by both (say, for a U+2581 in them) have no tokens: zeros and an empty ``groups_sha256``.
    Texts of any length are aligned whole, about a million characters at a time.  Every row is a document, repeated
    rows and null ids too.  Equal counts are all best.  An empty table gives two empty tables; other columns of
    ``docs`` are not read.
    """
    index = postings(docs, path_a, path_b, ranks, id_col, text_col)
    counts = written(pair_counts(index), "pairs")
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    pairs = counts.select(F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "n_docs", "n_links")
    return scored(index, counts, size).withColumnRenamed("id", id_col), pairs
