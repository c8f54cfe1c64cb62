"""Secret scans with built-in functions only.

Known shapes are found by patterns, whose places follow from the text between and inside the matches.  Other
secrets are found in candidate strings, long runs of key characters: a window slides over each, its
character counts are changed by the one that enters and the one that leaves, and where its Shannon entropy
reaches the bound of the string's character class, the window is a finding.  Windows that touch are one
span.  An allow-list of shapes (plain words, numbers, identifiers in UUID form, paths, placeholders)
suppresses candidates, never the findings of a pattern.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import text_of

# The known shapes, as (kind, pattern, group whose length is tested, least length of it).
SHAPES = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # equal to runs of any length of which those under 24 are dropped
)
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# Candidates that are no secrets, as patterns; ``allowed`` tests the same without a repeated group,
# which a backtracking engine would follow by one stack frame a repetition.
ALLOWED = (
    "[A-Za-z_/=+-]+",  # no digit: words, paths, rules
    "[0-9_/=+-]+",  # no letter: numbers, dates, lines
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "(?:/?[A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}",
    "(?:[A-Za-z]{2,14}[-_])+[A-Za-z]*[0-9]{0,4}",
    ".*(?i:example|placeholder|changeme|x{6}|0{6}|123456).*",
)
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates that ``pattern`` matches whole; ``bits``: the least entropy of a finding's window."""

    pattern: str
    bits: float


#: Tried in order; the first that matches a candidate judges it.
CLASSES = (
    EntropyClass("[0-9a-f]+|[0-9A-F]+", 3.0),
    EntropyClass("[0-9A-Z]+|[0-9a-z]+", 3.6),
    EntropyClass(".*", 3.8),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str,
            part: int = 256) -> Column:
    """What a state machine puts out over an array: ``step(state, item)`` is a struct ``state``, ``out`` (null: nothing).

    Outputs, of type ``kind``, gather in parts, as every step copies what is carried along.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return bind(step(acc["state"], x), lambda r: F.struct(
            r["state"].alias("state"),
            F.when(r["out"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(r["out"]))).alias("out")))

    def many(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(inner, lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def over(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / part).cast("int")),
                            lambda k: F.slice(xs, k * part + 1, F.lit(part)))
        begun = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) == 0, none).otherwise(
            F.aggregate(parts, begun, many, lambda acc: F.flatten(acc["out"])))

    return bind(items, over)


_PLACE = "struct<start:int,end:int,value:string,tested:string>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value, tested>> of the leftmost non-overlapping matches, in code points."""
    def place(gaps: Column) -> Column:
        hits = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
            lambda h, t: F.struct(h.alias("value"), t.alias("tested")))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

        def step(at: Column, p: Column) -> Column:
            value, start = p["hit"]["value"], at + F.length(p["gap"])
            end = start + F.coalesce(F.length(value), F.lit(0))
            span = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), p["hit"]["tested"].alias("tested"))
            return F.struct(end.alias("state"), F.when(value.isNotNull(), span).alias("out"))

        return running(pairs, F.lit(0), step, _PLACE)

    hits = bind(F.split(text, pattern, -1), place)
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(f"array<{_PLACE}>"))


def allowed(value: Column) -> Column:
    """Whether one of ``ALLOWED`` matches a candidate whole."""
    def dashed(w: Column) -> Column:
        last = F.substring_index(w, "-", -1)
        head = F.left(w, F.length(w) - F.length(last))  # "ab-cde-": words and dashes by turns
        return (F.contains(w, F.lit("-")) & ~head.rlike("[^A-Za-z-]") & ~head.rlike("^-|--|^[A-Za-z]-|-[A-Za-z]-")
                & ~head.rlike("[A-Za-z]{15}") & last.rlike("^[A-Za-z]*[0-9]{0,4}$"))

    # parts of 1 to 15 characters, one or two slashes between them, one before the last, at most one in front
    path = (value.rlike("[^/]/") & ~value.rlike("[^A-Za-z0-9_/-]") & ~value.rlike("^//|///|//[^/]*$")
            & ~value.rlike("[^/]{16}"))
    return (~value.rlike("[^A-Za-z_/=+-]") | ~value.rlike("[^0-9_/=+-]") | value.rlike(f"^{ALLOWED[2]}$") | path
            | bind(F.translate(value, "_", "-"), dashed)
            | value.rlike("(?i)example|placeholder|changeme|x{6}|0{6}|123456"))


def _spans(items: Column, kind_no: int) -> Column:
    return F.transform(items, lambda x: F.struct(
        x["start"].alias("start"), F.lit(kind_no).alias("kind_no"), x["end"].alias("end")))


def shaped(text: Column, kind_no: int) -> Column:
    """array<struct<start, kind_no, end>> of one known shape."""
    _, pattern, group, least = SHAPES[kind_no]
    if kind_no == 1:
        hits = F.when(F.contains(text, F.lit("AKIA")), found(text, pattern, group))
    else:
        hits = found(text, pattern, group)
    hits = F.filter(hits, lambda x: F.length(x["tested"]) >= least)
    return F.coalesce(_spans(hits, kind_no), F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))


def hot_windows(value: Column, most: Column, window: int) -> Column:
    """array<struct<start, end>>: the united windows of ``value`` whose sum of c * log2 c is at most ``most``
    (thousandths), which is an entropy bound turned round; counts move by one character at a time."""
    weights = F.array(*[F.lit(round(1000 * c * math.log2(c)) if c else 0) for c in range(window + 1)])
    start = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET) + 1).alias("counts"), F.lit(0).alias("sum"),
        F.lit(-1).alias("from"), F.lit(-1).alias("to"))

    def of(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            come = F.get(codes, i - 1)
            gone = F.when(i > window, F.get(codes, i - 1 - window)).otherwise(-1)

            def moved(g: Column) -> Column:
                come_, gone_ = g["come"], g["gone"]
                nc = F.get(s["counts"], come_)
                ng = F.get(s["counts"], F.greatest(gone_, F.lit(0)))
                change = F.when(come_ == gone_, 0).otherwise(
                    F.get(weights, nc + 1) - F.get(weights, nc)
                    + F.when(gone_ >= 0, F.get(weights, ng - 1) - F.get(weights, ng)).otherwise(0))
                counts = F.when(come_ == gone_, s["counts"]).otherwise(F.transform(
                    s["counts"], lambda c, k: c + F.when(k == come_, 1).when(k == gone_, -1).otherwise(0)))
                total = s["sum"] + change
                hot = (i >= window) & (i <= F.size(codes)) & (total <= most)
                joins = hot & (s["to"] >= i - window)
                closed = (s["to"] >= 0) & ((hot & ~joins) | (i > F.size(codes)))
                state = F.struct(
                    counts.alias("counts"), total.alias("sum"),
                    F.when(joins, s["from"]).when(hot, i - window).otherwise(s["from"]).alias("from"),
                    F.when(hot, i).otherwise(s["to"]).alias("to"))
                return F.struct(state.alias("state"), F.when(closed, F.struct(
                    s["from"].alias("start"), s["to"].alias("end"))).alias("out"))

            return bind(F.struct(F.coalesce(come, F.lit(0)).alias("come"), gone.alias("gone")), moved)

        # one step past the end closes the last span
        return running(F.sequence(F.lit(1), F.size(codes) + 1), start, step, "struct<start:int,end:int>")

    return bind(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c)), of)


def suspicious(text: Column, kind_no: int = len(SHAPES), window: int = 20) -> Column:
    """array<struct<start, kind_no, end>> of high-entropy stretches in candidates that no allowed shape covers."""
    def most(value: Column) -> Column:
        bound = None
        for kind in CLASSES:
            limit = F.lit(int((math.log2(window) - kind.bits) * window * 1000))
            whole = value.rlike(f"^(?:{kind.pattern})$")
            bound = F.when(whole, limit) if bound is None else bound.when(whole, limit)
        return bound

    def spans(c: Column) -> Column:
        hot = bind(most(c["value"]), lambda bound: hot_windows(c["value"], bound, window))
        return F.transform(hot, lambda h: F.struct(
            (c["start"] + h["start"]).alias("start"), F.lit(kind_no).alias("kind_no"),
            (c["start"] + h["end"]).alias("end")))

    cands = F.filter(found(text, CANDIDATE), lambda c: ~allowed(c["value"]))
    return F.flatten(F.transform(cands, spans))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


KINDS = [*(s[0] for s in SHAPES), "entropy"]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: array<struct<start, kind_no, end>> in code points, in order.

    ``spans`` holds the base spans and the entropy findings that no base span contains.  A null or empty text
    has none.  Columns of these names are replaced; repeated rows are scanned alike; an empty table stays empty.
    Texts and candidates of any length are scanned whole, in time that grows with them and not with their square.
    """
    kind = "struct<start:int,kind_no:int,end:int>"
    base = docs.select("*", text_of(docs, text_col).alias("__text"))
    text = F.col("__text")
    shapes = F.array_sort(F.concat(*[shaped(text, k) for k in range(len(SHAPES))]))
    scanned = base.withColumn("__shapes", shapes).withColumn("__hot", suspicious(text))

    def loose(reach: Column, x: Column) -> Column:
        """Base spans come before entropy findings of the same start; ``reach`` is the furthest end of any so far."""
        shape = x["kind_no"] < len(SHAPES)
        return F.struct(F.when(shape, F.greatest(reach, x["end"])).otherwise(reach).alias("state"),
                        F.when(shape | (reach < x["end"]), x).alias("out"))

    every = F.array_sort(F.concat(F.col("__shapes"), F.col("__hot")))
    return (scanned.withColumn("base_spans", F.col("__shapes"))
            .withColumn("spans", running(every, F.lit(-1), loose, kind))
            .drop("__text", "__shapes", "__hot"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 2048) -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap or touch share one.

    What stands between spans is taken from blocks of the text, so that no span walks the text from its start.
    """
    def of(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
            head = F.substring(F.coalesce(F.get(blocks, i), F.lit("")), a - i * block + 1,
                               F.when(i == j, b - a).otherwise(block))
            rest = F.when(j > i, F.concat(
                F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
                F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), b - j * block)))
            return F.concat(head, F.coalesce(rest, F.lit("")))

        def step(at: Column, x: Column) -> Column:
            fresh = (x["start"] > at) | (at < 0)
            gap = F.concat(between(F.greatest(at, F.lit(0)), x["start"]), F.lit(mark))
            return F.struct(F.greatest(at, x["end"]).alias("state"), F.when(fresh, gap).alias("out"))

        last = F.greatest(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0))
        return F.concat(F.array_join(running(spans, F.lit(-1), step, "string"), ""), between(last, F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(bind(blocks, of))
