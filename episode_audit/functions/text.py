"""Paths, templates, amounts and phrase scans as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{([a-zA-Z_]+)(?::0(\d+)d)?\}")


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """`{name}` and zero-padded `{name:0Nd}` slots filled from columns.

    Padding never shortens a longer number.
    """
    parts: list[Column] = []
    at = 0
    for slot in _SLOT.finditer(template):
        name, width = slot.group(1), slot.group(2)
        if name not in values:
            raise ValueError(f"template {template!r} needs {name!r}")
        if slot.start() > at:
            parts.append(F.lit(template[at : slot.start()]))
        text = values[name].cast("string")
        parts.append(F.lpad(text, F.greatest(F.length(text), F.lit(int(width))), F.lit("0")) if width else text)
        at = slot.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def path_problem(path: Column) -> Column:
    """Name of the first path rule broken, or null for a safe relative path."""
    segments = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(F.startswith(path, F.lit("/")), "leading slash")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(F.contains(path, F.lit("\x1f")), "separator byte")
        .when(F.exists(segments, lambda s: s == ""), "empty segment")
        .when(F.exists(segments, lambda s: s == ".."), "parent segment")
        .when(~path.rlike("^[A-Za-z0-9]"), "first character")
    )


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """Every forbidden phrase occurrence in the text, lower case, in order.

    Longer phrases are tried first, so a phrase hides the words inside it.
    """
    longest_first = sorted(phrases, key=len, reverse=True)
    pattern = r"(?i)\b(" + "|".join(re.escape(p) for p in longest_first) + r")\b"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.lower)


def amount_text(units: Column, decimals: int) -> Column:
    """Integer units as decimal text without trailing zeros.

    The digits are cut as text: decimal division keeps too few places for 18 decimals.
    """
    digits = units.cast("decimal(38,0)").cast("string")
    sign = F.when(F.startswith(digits, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(digits, "^-", "")
    if not decimals:
        return F.concat(sign, body)
    padded = F.lpad(body, F.greatest(F.length(body), F.lit(decimals + 1)), F.lit("0"))
    integer, rest = F.substring(padded, F.lit(1), F.length(padded) - decimals), F.right(padded, F.lit(decimals))
    return F.concat(sign, F.regexp_replace(F.concat(integer, F.lit("."), rest), r"\.?0+$", ""))


def short_hash(hex_column: Column, shown: int = 8) -> Column:
    return F.concat(F.substring(hex_column, 1, shown), F.lit("…"), F.substring(hex_column, -4, 4))


def iso_time(unix_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
