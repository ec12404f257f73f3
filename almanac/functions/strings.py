"""Text expressions: cleaning, packed lists, relevance rules and request keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip_tags(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), "<[^>]+>", "")


def clean_text(column: Column | str) -> Column:
    """Tags removed, lower case, trimmed."""
    return F.trim(F.lower(strip_tags(column)))


def packed_number(column: Column | str, index: int, separator: str = ",") -> Column:
    """The ``index``-th part of a packed list as a double; NULL when absent or not a number."""
    return F.get(F.split(_c(column), separator), index).try_cast("double")


def packed_items(column: Column | str, separator: str = ";") -> Column:
    """Non-empty parts of a packed list."""
    return F.filter(F.split(_c(column), separator), lambda x: x != "")


def any_theme_prefix(column: Column | str, themes: Sequence[str]) -> Column:
    """True when any item of a ``;`` list starts with one of ``themes``, ignoring case; NULL counts as no."""
    upper = F.concat(F.lit(";"), F.upper(_c(column)))
    found = F.lit(False)
    for theme in themes:
        found = found | upper.contains(f";{theme}")
    return F.coalesce(found, F.lit(False))


def any_keyword(column: Column | str, keywords: Sequence[str]) -> Column:
    """True when the lower-cased text contains any keyword; NULL counts as no."""
    lower, found = F.lower(_c(column)), F.lit(False)
    for keyword in keywords:
        found = found | lower.contains(keyword)
    return F.coalesce(found, F.lit(False))


def market_filter(column: Column | str, names: Sequence[str]) -> Column:
    return F.coalesce(_c(column).rlike("(?i)" + "|".join(names)), F.lit(False))


def by_rules(column: Column | str, rules: Sequence[tuple[str, str]], rest: str) -> Column:
    """Label of the first rule whose LIKE pattern matches."""
    value, label = _c(column), None
    for pattern, name in rules:
        label = F.when(value.like(pattern), name) if label is None else label.when(value.like(pattern), name)
    return label.otherwise(rest)


def request_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the key-sorted JSON form of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def any_script_words(text: Column | str) -> Column:
    """Lower-case words and numbers of a whole text in any script, in order."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced_words(text: Column | str) -> Column:
    """The words of :func:`any_script_words` with one space between; a text may begin or end with a space."""
    return F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " ")
