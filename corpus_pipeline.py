"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) over all rows that its predecessor kept; ``run`` writes each
result as Parquet to the shared folder and reads it again for the next.  All but the last stage return the
columns of ``documents``.  No stage can be written in SQL as a whole (trained trees, XXH64 balls, Burrows-Wheeler
transforms, a tokenizer), so there is no SQL twin; the tests hold stages against brute force.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from costlake.llm import packing, quality, secrets, simhash, substrings
from costlake.llm.common import crc_mod, discard, read_table, release, tables, written
from costlake.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


_LEFT: list[str] = []  # scratch tables of the stage before


def _stage(build: Stage) -> Stage:
    """A stage reads its predecessor's stored result, so the scratch tables that the predecessor built go."""

    @functools.wraps(build)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT, docs)
        before = set(tables())
        result = build(spark, docs, sf_dir)
        _LEFT[:] = [path for path in tables() if path not in before]
        return result

    return run


def _recounted(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    return _documents(rows.withColumn("n_chars", F.length("text").cast("long")))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    labels = read_table(spark, sf_dir, "labels")
    return quality.keep_good(_documents(docs), labels, crc_mod(docs.doc_id, 5) == 0, threshold=0.3)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__place``, a row's file and its number there; rows that come from no file are stored first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(*COLUMNS, place.alias("__place"))
    except AnalysisException:
        return written(_documents(docs), "rows").select(*COLUMNS, place.alias("__place"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null ids last.

    Fingerprints of four-word shingles link at four bits or fewer.  Rows are told apart by their place in the stored input, so
    repeated rows and null ids are grouped like any others.
    """
    rows = _placed(docs)
    groups = simhash.near_groups(rows, radius=4, words_per_shingle=4, carry=("__place",))
    gone = groups.where(~F.col("is_first")).select("__place")
    return _documents(rows.join(gone, "__place", "left_anti"))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document has go; a character of which a byte goes, goes whole.

    A document of which nothing is left stays as an empty text: it is no junk, its text is in others.
    """
    tag = F.to_json(F.struct("doc_id", "lang", "source", F.col("text").isNull().alias("none")))

    def kept(tag, raw, keep):
        row = json.loads(tag)
        text = None if row["none"] else substrings.without(raw, keep)
        return row.get("doc_id"), text, row.get("lang"), row.get("source"), None if text is None else len(text)

    return _documents(substrings.remove_repeats(
        _documents(docs).withColumn("__tag", tag), kept,
        "doc_id long, text string, lang string, source string, n_chars long", tag_col="__tag"))


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; a null text stays null."""
    found = secrets.scan(_documents(docs))
    return _recounted(found.withColumn("text", secrets.masked(F.col("text"), F.col("spans"))))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, in windows of 1,024: one row per piece, with its ids and its place."""
    cut = packing.cut_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024, packing.ids_of, "array<int>",
                                ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut, 1024).withColumnRenamed("value", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
