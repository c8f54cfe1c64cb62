"""Resource tags: defaults and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def default_tags(tags: Column | str, defaults: dict[str, Column | str]) -> Column:
    """Add each default whose key is absent; keys already present win, a null map gets them all."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    pairs = []
    for key, value in defaults.items():
        pairs += [F.lit(key), F.lit(value) if isinstance(value, str) else value]
    wanted = F.create_map(*pairs)
    missing = F.map_filter(wanted, lambda key, _: ~F.map_contains_key(tags, key))
    return F.when(tags.isNull(), wanted).otherwise(F.map_concat(missing, tags))


def tag_gap(tags: Column | str) -> Column:
    """``untagged`` without any map, ``missing_owner`` without that key, otherwise ``none``."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return (
        F.when(tags.isNull(), F.lit("untagged"))
        .when(~F.map_contains_key(tags, "owner"), F.lit("missing_owner"))
        .otherwise(F.lit("none"))
    )


def tag_gap_report(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records and spend per class of tag gap."""
    return records.groupBy(*by, tag_gap("tags").alias("tag_gap")).agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount")
    )
