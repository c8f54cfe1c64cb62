"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from costlake.llm import (
    alignment, attribution, bpe_reuse, conversation_trie, embedding_dedup, langid, native_queries, neighbours, packing,
    quality, simhash, substrings)
from costlake.llm.common import crc_mod, read_table

QUERIES = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """The installed public tokenizer file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, radius=4, words_per_shingle=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, crc_mod(docs.doc_id, 5) == 0, threshold=0.3)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, crc_mod(docs.doc_id, 4) == 2)


@query
def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cut = packing.cut_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024, packing.crc_of, "bigint",
                                ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut, 1024).withColumnRenamed("value", "ids_crc32")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return attribution.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), rule="start",
                                    ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


@query
def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")

    names = [str(i) for i in range(1 << 16)]

    def digests(parts, ids):
        return {
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [sha256(" ".join([names[j] for j in i.tolist()]).encode()).hexdigest() for i in ids],
            "decoded_sha256": [sha256(bpe_reuse.decode_ids(path, i)).hexdigest() for i in ids],
        }

    return bpe_reuse.encode_texts(read_table(spark, sf_dir, "documents"), path, digests,
                                  "n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(doc_id, raw, keep):
        cut = np.diff(np.concatenate([[1], keep.astype(np.int8)]))
        kept = raw if keep.all() else np.frombuffer(raw, np.uint8)[keep].tobytes()
        return doc_id, len(raw), int(len(raw) - keep.sum()), int((cut == -1).sum()), sha256(kept).hexdigest()

    return substrings.remove_repeats(
        read_table(spark, sf_dir, "documents"), digest,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = conversation_trie.encoded(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(lists, 20, crc_mod(F.col("conv_id"), 4)))


#: CRC-32 bit by bit: a byte comes in, then eight shifts.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295), 4294967295)"""

ORACLES["op11_conversation_trie"] = f"""
WITH t AS (SELECT conv_id, [coalesce(role, ''), coalesce(text, '')] AS said, turn AS pos FROM conversations
           WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos NULLS FIRST) AS seq FROM t GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC32} % 4 AS BIGINT) AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.seq[:h.h], []), h.seq[h.h + 1:]) AS seq
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(seq) = d AS ends, d, seq[:d] AS pre FROM (
        SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM p GROUP BY pre, d),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children,
        CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(list_filter(
          string_split_regex(n.pre[n.d][2], '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
      FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.pre = n.pre[:n.d - 1]
      LEFT JOIN (SELECT pre[:d - 1] AS up, d - 1 AS up_d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) c
        ON c.up_d = n.d AND c.up = n.pre),
s AS (SELECT pre[:a] AS pre, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT pre, saved, n_children, unnest(range(0, d + 1)) AS a FROM k) GROUP BY ALL)
SELECT CAST(k.conv_id AS BIGINT) AS conv_id, CAST(k.d AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id,
  CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN s ON s.d = k.d AND s.pre = k.pre"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = alignment.align(
        read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return documents


@query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES.update(native_queries.QUERIES)
ORACLES.update(native_queries.ORACLES)
