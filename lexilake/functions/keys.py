"""Key style: separators, case patterns, forbidden prefixes, platform spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pattern and one separator per key style.
CASE_PATTERNS = {
    "dotted.lower": r"\A[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)*\z",
    "kebab": r"\A[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z",
    "screaming_snake": r"\A[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\z",
    "snake": r"\A[a-z][a-z0-9]*(?:_[a-z0-9]+)*\z",
}
SEPARATORS = {"dotted.lower": ".", "kebab": "-", "screaming_snake": "_", "snake": "_"}
TRANSFORM_SEPARATORS = {"identity": ".", "snake_case": "_", "kebab-case": "-"}


def _by_value(selector: Column, options: dict[str, Column]) -> Column:
    chosen = None
    for value, result in options.items():
        chosen = F.when(selector == value, result) if chosen is None else chosen.when(selector == value, result)
    return chosen


def key_matches_case(key: Column, key_case: Column) -> Column:
    return _by_value(key_case, {case: key.rlike(p) for case, p in CASE_PATTERNS.items()})


def split_key(key: Column, key_case: Column) -> Column:
    """Segments of a key under its project's style, empty ones kept."""
    return _by_value(
        key_case, {case: F.split(key, "\\" + sep if sep == "." else sep, -1) for case, sep in SEPARATORS.items()}
    )


def first_forbidden_prefix(key: Column, prefixes: Column) -> Column:
    """First prefix in configured order that the key starts with, else NULL."""
    return F.get(F.filter(prefixes, lambda p: (p != "") & F.startswith(key, p)), 0)


def transform_key(key: Column, key_transform: str | Column) -> Column:
    """Canonical spelling to platform spelling."""
    if isinstance(key_transform, str):
        return F.replace(key, F.lit("."), F.lit(TRANSFORM_SEPARATORS[key_transform]))
    return _by_value(key_transform, {t: transform_key(key, t) for t in TRANSFORM_SEPARATORS})


def reverse_key(key: Column, key_transform: str | Column) -> Column:
    """Platform spelling back to canonical; lossy, every separator becomes a dot."""
    if isinstance(key_transform, str):
        return F.replace(key, F.lit(TRANSFORM_SEPARATORS[key_transform]), F.lit("."))
    return _by_value(key_transform, {t: reverse_key(key, t) for t in TRANSFORM_SEPARATORS})


def restyle_key(key: Column, key_case: Column) -> Column:
    """A deterministic destination in the project's style: words re-joined by its separator."""
    words = F.filter(F.split(F.lower(key), r"[^a-z0-9]+"), lambda w: w != "")
    return _by_value(
        key_case,
        {
            case: F.upper(F.array_join(words, sep)) if case == "screaming_snake" else F.array_join(words, sep)
            for case, sep in SEPARATORS.items()
        },
    )
