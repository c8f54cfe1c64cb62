"""Language identification by cross-parsing.

The labelled text of a language is held in a suffix automaton, that is, in an automaton of all its
substrings.  A text is parsed into the longest phrases that occur there; the language that needs the
fewest phrases wins, each count weighted by the bits that point into the language's text (the
cross-parsing entropy).  All languages learn from about the same length of text.  The automata are dense tables, and a batch of texts is parsed side by side, one character of all blocks at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import slices, text_of

_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 256


def suffix_automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Dense transitions [state, symbol] of all substrings of ``symbols`` (-1: none; state 0: empty)."""
    most = 2 * len(symbols) + 2
    step = np.full((most, alphabet), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and step[p, c] < 0:
            step[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step[clone] = step[q]
                while p >= 0 and step[p, c] == q:
                    step[p, c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step[:len(link)]


@dataclass
class Parser:
    """One language: ``table[state * alphabet + symbol]`` is 2 * next state + (1 if a phrase ended)."""

    table: np.ndarray
    bits: float  # of one phrase: log2 of the learned length


@dataclass
class Languages:
    names: list[str]
    codes: np.ndarray  # code point -> symbol
    alphabet: int
    parsers: list[Parser]


def _symbols(codes: np.ndarray, text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[np.minimum(points, len(codes) - 1)]


def phrases(parser: Parser, alphabet: int, blocks: np.ndarray, begins: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """(phrases that end in each column of ``blocks`` [position, block], the last state); symbol -1 is past the end.

    The blocks of a text follow each other, ``begins`` marks its first, and ``carried`` is the state before the first column.
    All blocks are parsed from the empty state at once; then each is parsed again from the state in which the
    block before it really ends, until both parses are in the same state, from where they agree.
    """
    state = np.zeros(blocks.shape[1], np.int32)
    count = np.zeros(blocks.shape[1], np.int64)
    path = np.empty(blocks.shape, np.int32)
    for i, row in enumerate(blocks):
        if row.min() < 0:
            live = row >= 0
            moved = parser.table[state * alphabet + np.maximum(row, 0)]
            count += (moved & 1) * live
            state = np.where(live, moved >> 1, state)
        else:
            moved = parser.table[state * alphabet + row]
            count += moved & 1
            state = moved >> 1
        path[i] = state
    ends, change = path[-1].copy(), np.zeros(len(count), np.int64)
    start = np.append(np.int32(carried), ends[:-1])
    start[begins] = 0
    lanes = np.nonzero(start)[0]
    while len(lanes):
        change[lanes], last = _again(parser, alphabet, blocks, path, lanes, start[lanes])
        late = lanes[last != ends[lanes]] + 1  # what follows a block that ends elsewhere than thought
        ends[lanes] = last
        lanes = late[late < len(count)]
        lanes = lanes[~begins[lanes]]
        start[lanes] = ends[lanes - 1]
    return count + change, int(ends[-1])


def _again(parser: Parser, alphabet: int, blocks: np.ndarray, path: np.ndarray, lanes: np.ndarray,
           start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases more than in the parse ``path``, last state) of some columns parsed from ``start``."""
    change, last = np.zeros(len(lanes), np.int64), path[-1, lanes].copy()
    state, active = start.copy(), np.arange(len(lanes))
    for i, row in enumerate(blocks):
        row = row[lanes[active]]
        active, row = active[row >= 0], row[row >= 0]
        if not len(active):
            return change, last
        before = path[i - 1, lanes[active]] if i else np.zeros(len(active), np.int32)
        mine = parser.table[state[active] * alphabet + row]
        other = parser.table[before * alphabet + row]
        change[active] += (mine & 1) - (other & 1)
        state[active] = mine >> 1
        active = active[mine >> 1 != other >> 1]
    last[active] = state[active]
    return change, last


def parse_counts(models: Languages, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases [text, language], symbols [text]) of whole texts by longest matches; 256 characters of many blocks advance
    at once."""
    coded = [_symbols(models.codes, t) for t in texts]
    sizes = np.array([len(c) for c in coded])
    per = -(-sizes // _BLOCK)
    owner = np.repeat(np.arange(len(texts)), per)
    full = np.full((int(per.sum()), _BLOCK), -1, np.int32)
    at = 0
    for symbols, k in zip(coded, per.tolist()):
        full[at:at + k].reshape(-1)[:len(symbols)] = symbols
        at += k
    begins = np.append(True, owner[1:] != owner[:-1])[:len(owner)]
    out = np.zeros((len(texts), len(models.parsers)))
    carried = [0] * len(models.parsers)
    for begun in range(0, len(full), 16384):
        part = slice(begun, begun + 16384)
        blocks = np.ascontiguousarray(full[part].T)
        for j, parser in enumerate(models.parsers):
            ended, carried[j] = phrases(parser, models.alphabet, blocks, begins[part], carried[j])
            out[:, j] += np.bincount(owner[part], ended, len(texts))
    return out + (sizes > 0)[:, None], sizes  # the end of a text closes a phrase


def learn(samples: dict[str, list[str]], chars: int = 20_000, alphabet: int = 96) -> Languages:
    """An automaton per language, of ``chars`` characters or what the language with the least text has
    (but 4,000 at least where there are so many), spread evenly over its texts."""
    names = sorted(samples)
    seen = np.zeros(0x10000, np.int64)
    for texts in samples.values():
        for t in texts:
            points = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            seen += np.bincount(np.minimum(points, 0xFFFF), minlength=0x10000)
    common = np.argsort(-seen, kind="stable")[:alphabet - 1]
    codes = np.full(0x10000, alphabet - 1, np.int32)  # the rest share the last symbol
    codes[common] = np.arange(len(common))
    size = min(chars, max(4_000, min(sum(map(len, texts)) for texts in samples.values())))
    parsers = []
    for name in names:
        texts = sorted(set(samples[name]), key=lambda t: (len(t), t))
        parts, left = [], size
        for i, t in enumerate(texts):  # short ones whole, the others the same share of what is left
            parts.append(t[:max(1, left // (len(texts) - i))])
            left -= len(parts[-1])
        taught = _symbols(codes, "\n".join(parts))
        step = suffix_automaton(taught, alphabet)
        root = np.where(step[0] >= 0, step[0], 0)
        table = np.where(step >= 0, 2 * step, 2 * root + 1).astype(np.int32).ravel()
        parsers.append(Parser(table, float(np.log2(max(len(taught), 2)))))
    return Languages(names, codes, alphabet, parsers)


def decide(models: Languages, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language or ``und``, score); the score is the winner's share by its lead in phrases."""
    found = [bool(t) and _LETTER.search(t) is not None for t in texts]
    counts, sizes = parse_counts(models, [t or "" for t in texts])
    cost = counts * np.array([p.bits for p in models.parsers])
    best = cost.argmin(axis=1)
    lead = (cost - cost.min(axis=1, keepdims=True)) / np.maximum(sizes[:, None], 1) * np.minimum(sizes[:, None], 400)
    weight = np.exp2(-np.minimum(lead / 8, 60))
    share = 1 / weight.sum(axis=1)
    return ([models.names[b] if ok else "und" for b, ok in zip(best, found)], np.where(found, share, 0.0))


def training_texts(docs: DataFrame, teaches: Column, texts: int = 300, stretch: int = 1_500,
                   lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[str]]:
    """At most ``texts`` texts per language, those whose ids hash smallest, each cut to a middle stretch of
    ``stretch`` characters: the bounded sample that a language is learned from."""
    from pyspark.sql import Window

    text = text_of(docs, text_col)
    start = F.greatest(F.lit(1), ((F.length(text) - stretch) / 2).cast("int"))
    rows = docs.where(teaches & docs[lang_col].isNotNull() & (F.length(F.trim(text)) > 0)).select(
        docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[id_col].cast("string")).alias("at"),
        text.substr(start, F.lit(stretch)).alias("part"))
    newest = Window.partitionBy("lang").orderBy("at", "part")
    few = rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= texts).drop("n")
    samples: dict[str, list[str]] = {}
    for row in few.orderBy("lang", "at", "part").collect():  # texts * languages short stretches
        samples.setdefault(row.lang, []).append(row.part)
    return samples


def identify(docs: DataFrame, held_out: Column, chars: int = 20_000, texts: int = 300, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, ``held_out``, ``lang_pred``, ``score``) of every row.

    ``held_out`` is a condition on ``docs``; its true rows and rows without a language teach nothing.  A text
    that is null or has no letter is ``und`` with score 0, and so is every text where nothing was
    learned.  A null id keeps its row with ``held_out`` false and teaches nothing.  Texts of any length are parsed whole;
    equal costs go to the language that comes first by name; repeated rows are judged alike and teach as often
    as they are among the ``texts`` drawn; an empty table gives none.
    """
    out = F.coalesce(held_out, F.lit(False))
    samples = training_texts(
        docs, ~out & docs[id_col].isNotNull(), texts, lang_col=lang_col, text_col=text_col, id_col=id_col)
    models = docs.sparkSession.sparkContext.broadcast(learn(samples, chars) if samples else None)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                read = part.column("text").to_pylist()
                if models.value is None:
                    names, scores = ["und"] * len(read), np.zeros(len(read))
                else:
                    names, scores = decide(models.value, read)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                    names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), out.alias("held_out"),
                       text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed(
        "id", id_col)
