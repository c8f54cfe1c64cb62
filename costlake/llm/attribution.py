"""Token counts per section by offset-mapped attribution.

A whole document is encoded once.  Each token covers a span of its characters, each section (a field, a line,
a paragraph) covers another; both lists are sorted, and their interval join gives every token its
section.  A token that crosses section borders goes by the rule that the caller names:
``start`` (to the section of its first byte), ``end`` (of its last byte) or ``largest`` (to the section that
holds most of its bytes, the first of equals).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costlake.llm import tokens
from costlake.llm.common import slices, text_of

RULES = ("start", "end", "largest")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section; both lists cover the text from 0 without gaps, ends exclusive.

    A token counts once.  A crossing token is counted as crossing in the section that it is given to.
    """
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.maximum(np.searchsorted(section_ends, token_ends - 1, side="right"), first)
    chosen = first.copy() if rule != "end" else last.copy()
    crossing = np.nonzero(last > first)[0]
    if rule == "largest":
        for t in crossing.tolist():
            edges = np.concatenate([[starts[t]], section_ends[first[t]:last[t]], [token_ends[t]]])
            chosen[t] = first[t] + int(np.diff(edges).argmax())
    n = len(section_ends)
    return np.bincount(chosen, minlength=n)[:n], np.bincount(chosen[crossing], minlength=n)[:n]


def line_sections(raw: bytes) -> list[tuple[str, int]]:
    """(name, end in bytes) of the lines of a text, each with its line end."""
    lines = raw.split(b"\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] -= 1
    return [(str(i), int(e)) for i, e in enumerate(ends.tolist()) if i == 0 or len(lines[i]) or i < len(lines) - 1]


def token_counts(docs: DataFrame, path: str, sections: Callable[[bytes], list[tuple[str, int]]] = line_sections,
                 rule: str = "start", ranks: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ``section_no``, ``section``, ``start``, ``length``, ``n_tokens``, ``n_crossing``) per section.

    ``path`` names a byte-level tokenizer.  ``start`` and ``length`` are in code points.  The counts of a document
    add up to the tokens of its whole text.  A null or empty text has one empty section without tokens; repeated
    rows and null ids keep their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))

    def run(batches):
        own = tokens.encoder(path, "leading", ranks)
        sizes = tokens.byte_lengths(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                columns: list[list] = [[] for _ in range(7)]
                for doc_id, text, ids in zip(part.column("id").to_pylist(), texts, own.encode(texts)):
                    raw = text.encode("utf-8", "replace")
                    found = sections(raw)
                    ends = np.array([e for _, e in found], np.int64)
                    token_ends = np.cumsum(sizes[np.frombuffer(ids, own.dtype)])
                    counts, crossing = (attribute(token_ends, ends, rule) if len(token_ends)
                                        else (np.zeros(len(ends), int),) * 2)
                    if len(raw) != len(text):  # byte ends to code point ends
                        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                        ends = np.concatenate([[0], np.cumsum(lead)])[ends]
                    begins = np.concatenate([[0], ends[:-1]])
                    for column, values in zip(columns, (
                            [doc_id] * len(ends), range(len(ends)), [n for n, _ in found], begins.tolist(),
                            (ends - begins).tolist(), counts.tolist(), crossing.tolist())):
                        column.extend(values)
                kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["id", "section_no", "section", "start", "length", "n_tokens", "n_crossing"])

    return rows.mapInArrow(
        run, "id long, section_no int, section string, start long, length long, n_tokens long, n_crossing long",
    ).withColumnRenamed("id", id_col)
