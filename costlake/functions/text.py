"""Masking, redaction, naming and formatting of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Unicode white space, written out because ``\\s`` alone means ASCII in Java.
_SPACE = (r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}")

#: Credential-like text, replaced in this order.
CREDENTIAL_PATTERNS = (
    rf"(?iu)(key|secret|token|password|credential|authorization)[=:][{_SPACE}]*[^{_SPACE}]+"
    rf"([{_SPACE}]+[^{_SPACE}]+)?",
    r"AKIA[0-9A-Z]{16}",
    rf"(?iu)Bearer[{_SPACE}]+[^{_SPACE}]+",
)
REDACTED = "[REDACTED]"

#: Ordered (markers, bucket) rules on the lower-cased service name.
BUCKET_RULES = (
    (("lambda", "function"), "serverless"),
    (("sql", "rds", "database"), "database"),
    (("storage", "s3", "blob"), "storage"),
    (("cdn", "cloudfront"), "delivery"),
)
DEFAULT_BUCKET = "compute"

#: One colour per severity.
SEVERITY_COLORS = {
    "critical": "#e74c3c",
    "high": "#e67e22",
    "medium": "#f1c40f",
    "low": "#3498db",
    "info": "#2ecc71",
}
OTHER_COLOR = "#95a5a6"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mask_identifier(value: Column | str) -> Column:
    """Hide the middle of an identifier; short ones vanish wholly, missing ones read ``all``."""
    value = _col(value)
    return (
        F.when(value.isNull() | (value == ""), F.lit("all"))
        .when(F.length(value) <= 6, F.lit("***"))
        .otherwise(F.concat(F.substring(value, 1, 2), F.lit("***"), F.right(value, F.lit(4))))
    )


def redact_text(text: Column | str, max_length: int = 500) -> Column:
    """Blank out credentials in the whole text, then shorten it for display."""
    text = _col(text)
    for pattern in CREDENTIAL_PATTERNS:
        text = F.regexp_replace(text, pattern, F.lit(REDACTED))
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("…"))
    ).otherwise(text)


def service_bucket(service: Column | str) -> Column:
    """Coarse workload class of a service name; the first matching rule wins."""
    name = F.lower(_col(service))
    bucket = F.lit(DEFAULT_BUCKET)
    for markers, label in reversed(BUCKET_RULES):
        hit = F.lit(False)
        for marker in markers:
            hit = hit | name.contains(marker)
        bucket = F.when(hit, F.lit(label)).otherwise(bucket)
    return bucket


def service_slug(service: Column | str) -> Column:
    """Lower-case, dash-separated form of a service name."""
    dashed = F.regexp_replace(F.lower(_col(service)), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def short_service_name(service: Column | str) -> Column:
    """The first two space-separated words."""
    return F.substring_index(_col(service), " ", 2)


def format_currency(amount: Column | str) -> Column:
    """``$1,234.50``, with the minus sign in front of the dollar sign."""
    amount = _col(amount)
    sign = F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, F.format_number(F.abs(amount), 2))


def format_percent(value: Column | str) -> Column:
    """Signed percentage with two decimals."""
    return F.format_string("%+.2f%%", _col(value).cast("double"))


def severity_color(severity: Column | str) -> Column:
    pairs = [F.lit(part) for item in SEVERITY_COLORS.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(severity)), F.lit(OTHER_COLOR))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct, trimmed, non-blank values of a column, sorted: the entries of a filter menu."""
    trimmed = df.select(F.trim(F.col(column)).alias("value"))
    return trimmed.filter(F.col("value") != "").distinct().orderBy("value")
