"""The two native operators as queries, with the SQL that must agree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlake.llm import rules, secrets
from costlake.llm.common import read_table


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))

    def n(kind_no: int):
        return F.size(F.filter("base_spans", lambda s: s["kind_no"] == kind_no)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base_spans"), secrets.KINDS), 256).alias("base_sha256"),
        secrets.listed(F.col("spans"), secrets.KINDS).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read_table(spark, sf_dir, "documents"))
    q = judged.quality
    base_failed = (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)
    return judged.select(
        "doc_id", q.n_words.alias("n_words"), q.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"),
        q.lines.n_dup_lines.cast("long").alias("n_dup_lines"), q.n_repeat_words.alias("n_repeat_words"),
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    """Gaps between matches give places here too; each window's entropy is counted afresh."""
    window = 20
    weights = ", ".join(str(round(1000 * c * math.log2(c)) if c else 0) for c in range(window + 1))
    allowed = "|".join(f"(?:{p})" for p in secrets.ALLOWED)
    bounds = " ".join(
        f"WHEN regexp_full_match(hit, {_quoted(k.pattern)}) THEN {int((math.log2(window) - k.bits) * window * 1000)}"
        for k in secrets.CLASSES)
    # RE2 has no look-behind; greedy runs of these characters start where one starts anyhow
    shapes = [*((k, name, p, g, least) for k, (name, p, g, least) in enumerate(secrets.SHAPES)),
              (3, "entropy", secrets.CANDIDATE.split(")", 1)[1], 0, 20)]
    parts = " UNION ALL ".join(f"""
        SELECT r, {k} AS kind_no, {least} AS least,
               regexp_extract_all(t, {_quoted(p)}, 0) AS hits, regexp_extract_all(t, {_quoted(p)}, {g}) AS tested,
               string_split_regex(t, {_quoted(p)}) AS gaps FROM d""" for k, _, p, g, least in shapes)
    names = "['assign', 'access', 'hex', 'entropy']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
p AS (SELECT r, kind_no, least, unnest(hits) AS hit, unnest(tested) AS probe, unnest(gaps[:len(hits)]) AS gap,
             unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
e AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind_no ORDER BY i) AS BIGINT) AS stop FROM p),
base AS (SELECT r, kind_no, stop - length(hit) AS start, stop FROM e WHERE kind_no < 3 AND length(probe) >= least),
cand AS (SELECT r, hit, stop - length(hit) AS pos, CASE {bounds} END AS most FROM e
         WHERE kind_no = 3 AND NOT regexp_full_match(hit, {_quoted(allowed)})),
win AS (SELECT r, hit, pos, most, unnest(range(1, length(hit) - {window} + 2)) AS a FROM cand),
hot AS (SELECT r, pos, a FROM win WHERE list_sum(list_transform(
          list_distinct(string_split(substr(hit, a, {window}), '')),
          lambda c: [{weights}][{window} - length(replace(substr(hit, a, {window}), c, '')) + 1])) <= most),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, pos ORDER BY a) AS run FROM (
          SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY r, pos ORDER BY a) <= {window} THEN 0 ELSE 1 END AS fresh
          FROM hot)),
loose AS (SELECT r, 3 AS kind_no, pos + min(a) - 1 AS start, pos + max(a) - 1 + {window} AS stop FROM runs
          GROUP BY r, pos, run),
extra AS (SELECT l.* FROM loose l ANTI JOIN base b ON b.r = l.r AND b.start <= l.start AND b.stop >= l.stop),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
listed AS (SELECT r, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
             count(*) FILTER (kind_no = 2) AS n_hex,
             string_agg({names}[kind_no + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop)
               FILTER (kind_no < 3) AS base,
             string_agg({names}[kind_no + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop) AS spans
           FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""


def _rules_sql() -> str:
    blank = "[\\x20\\x09-\\x0D]"
    stops = ", ".join(_quoted(w) for w in rules.STOP_WORDS)
    bounds = []
    for rule in rules.RULES:
        if rule.least is not None:
            bounds.append(f"{rule.name} < {rule.least}")
        if rule.most is not None:
            bounds.append(f"{rule.name} > {rule.most}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM (
        SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY r),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_intersect(list_distinct(ws), [{stops}])) AS stop_kinds,
        len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ellipses, len(ls) AS n_lines
      FROM w LEFT JOIN cov USING (r)),
q AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        n_repeat_words / greatest(n_words, 1) AS repeat_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
        n_bullets / greatest(n_lines, 1) AS bullet_share, n_ellipses / greatest(n_lines, 1) AS ellipsis_share,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(bounds)}) AS kept
FROM q"""


QUERIES = {f.__name__: f for f in (op2_secret_scan, op4_quality_rules)}
ORACLES = {"op2_secret_scan": _secret_sql(), "op4_quality_rules": _rules_sql()}
