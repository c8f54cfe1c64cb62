"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is an expression over the row's own text, so the whole filter is one pass over the scan
without a shuffle and without user functions.  Repeated three-word windows are found by sorting their hashes
next to their positions inside the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import text_of

_BLANKS = " \t\n\u000b\f\r"
_BLANK = "[\\x20\\x09-\\x0D]"

# Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the of and to in that is for on with "
    "der die und das ist nicht ein eine mit den zu "
    "de la le les et des une du que pour en "
    "el los las un una y con por del"
).split()


@dataclass(frozen=True)
class Rule:
    """``name``: a measure of ``measures`` that must lie between ``least`` and ``most`` (either may be None)."""

    name: str
    least: float | None = None
    most: float | None = None


#: The production table.  Ratios are per word or per line.
RULES = (
    Rule("n_words", least=50),
    Rule("repeat_share", most=0.5),
    Rule("mean_word", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.3),
    Rule("stop_kinds", least=2),
    Rule("dup_line_share", most=0.5),
    Rule("bullet_share", most=0.9),
    Rule("ellipsis_share", most=0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between blanks, none for an empty text."""
    cut = F.split(F.trim(text, F.lit(_BLANKS)), _BLANK + "+")
    return F.filter(cut, lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, all its places included.

    Sorting 44 bits of each window's hash together with its position brings equal windows together; the few
    neighbours that agree are then compared by the whole hash.  Texts of a million words and more sort
    the pairs of hash and position themselves.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twins(sorted_: Column, key: Callable[[Column], Column]) -> Column:
        """Elements whose neighbour has the same key."""
        def same(v: Column, j: Column) -> Column:
            before = (j > 0) & (key(F.get(sorted_, F.greatest(j - 1, F.lit(0)))) == key(v))
            after = (j + 1 < F.size(sorted_)) & (key(F.get(sorted_, j + 1)) == key(v))
            return before | F.coalesce(after, F.lit(False))
        return F.filter(sorted_, same)

    def candidates(h: Column) -> Column:
        packed = F.sort_array(F.transform(
            h, lambda x, i: F.shiftleft(F.shiftright(x, 20), 20).bitwiseOR(i.cast("long"))))
        near = let(packed, lambda p: twins(p, lambda v: F.shiftright(v, 20)))
        some = F.transform(near, lambda v: v.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
        return F.when(F.size(h) < (1 << 20), some).otherwise(F.transform(h, lambda x, i: i))

    def exact(h: Column) -> Column:
        pairs = F.array_sort(F.transform(
            candidates(h), lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: twins(p, lambda v: v["h"]))
        return F.sort_array(F.transform(twice, lambda v: v["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    some = let(hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(exact(h))).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(some)


def counts(text: Column) -> Column:
    """The counted measures of a text as a struct of longs."""
    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias(
                "n_ellipses"),
        ]

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(_BLANKS))) > 0)
        stops = F.array(*[F.lit(w) for w in STOP_WORDS])
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(*of_lines(x))).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_intersect(words, stops)).alias("stop_kinds"),
        )

    return let(words_of(text), of)


def measures(c: Column) -> dict[str, Column]:
    """The values that rules test, from the struct of ``counts``; all integers or quotients of two."""
    words = F.greatest(c["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(c["lines"]["n_lines"], F.lit(1)).cast("double")
    return {
        "n_words": c["n_words"],
        "mean_word": c["word_chars"] / words,
        "symbol_ratio": c["n_symbols"] / words,
        "repeat_share": c["n_repeat_words"] / words,
        "stop_kinds": c["stop_kinds"],
        "dup_line_share": c["lines"]["n_dup_lines"] / lines,
        "bullet_share": c["lines"]["n_bullets"] / lines,
        "ellipsis_share": c["lines"]["n_ellipses"] / lines,
    }


def compiled(rules: tuple[Rule, ...], c: Column) -> list[tuple[str, Column]]:
    """(rule name, condition that fails it) of every bound of the table."""
    values = measures(c)
    bounds = []
    for rule in rules:
        if rule.least is not None:
            bounds.append((f"{rule.name}<{rule.least:g}", values[rule.name] < F.lit(rule.least)))
        if rule.most is not None:
            bounds.append((f"{rule.name}>{rule.most:g}", values[rule.name] > F.lit(rule.most)))
    return bounds


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality`` (struct of counts), ``failed`` (names of broken bounds) and ``kept``.

    A null text is empty, has zero counts and fails the least length.  Columns named like the three new ones are
    replaced.  Repeated rows are judged alike; an empty table stays empty.  Long texts are measured whole and no rule
    rejects a text for its length.
    """
    base = docs.select("*", text_of(docs, text_col).alias("__text"))
    counted = base.withColumn("__counts", counts(F.col("__text")))
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in compiled(rules, F.col("__counts"))]))
    return (counted.withColumn("quality", F.col("__counts")).withColumn("failed", failed)
            .withColumn("kept", F.size("failed") == 0).drop("__text", "__counts"))
