"""Placeholders, blank text and glossary terms inside a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The message grammar.
PLACEHOLDER = r"\{([\w.-]+)\}"
PLURAL = r"\{\s*[\w.-]+\s*,\s*plural\s*,"
# Unicode white space plus the byte order mark; Spark's trim() knows U+0020 only.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANK = rf"\A[{JS_SPACE}]*\z"

PLACEHOLDER_TYPE = "struct<example:string,type:string>"


def is_blank(text: Column) -> Column:
    """True for NULL and for text made of white space only."""
    return text.isNull() | text.rlike(BLANK)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def extract_placeholders(text: Column) -> Column:
    """All placeholder names in order of appearance, repeats kept."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))


def contains_plural(text: Column) -> Column:
    return text.rlike(PLURAL)


def placeholder_counts(text: Column) -> Column:
    """The multiset of names, as a sorted array."""
    return F.array_sort(extract_placeholders(text))


def positional_order(text: Column) -> Column:
    """Names made of digits only, in order: these may not move."""
    return F.filter(extract_placeholders(text), lambda n: n.rlike(r"\A[0-9]+\z"))


def has_parity(source: Column, target: Column) -> Column:
    """Same names the same number of times, digits-only names in the same order.

    Types need no comparison: both sides look them up in the source's own map.
    """
    plain = ~source.contains("{") & ~target.contains("{")
    return plain | (
        (placeholder_counts(source) == placeholder_counts(target))
        & (positional_order(source) == positional_order(target))
    )


def _typed(name: Column, types: Column) -> Column:
    declared = F.try_element_at(types, name)["type"]
    return F.struct(name.alias("name"), F.coalesce(declared, F.lit("string")).alias("type"))


def unique_placeholders(text: Column, types: Column) -> Column:
    """Distinct names by first appearance, with the declared type or ``string``."""
    return F.transform(F.array_distinct(extract_placeholders(text)), lambda n: _typed(n, types))


def canonical_placeholders(text: Column, types: Column) -> Column:
    """Names used in the text, then the declared names the text leaves out."""
    used = F.array_distinct(extract_placeholders(text))
    unused = F.array_except(F.array_sort(F.map_keys(types)), used)
    return F.concat(unique_placeholders(text, types), F.transform(unused, lambda n: _typed(n, types)))


def placeholder_signature(placeholders: Column) -> Column:
    """``name:type`` pairs, sorted and joined: equal exactly when the sets agree."""
    return F.array_join(
        F.array_sort(F.transform(placeholders, lambda p: F.concat(p["name"], F.lit(":"), p["type"]))), "|"
    )


def contains_term(text: Column, term: Column) -> Column:
    """``term`` occurs with no Unicode letter touching it; a blank term always does."""
    quoted = F.regexp_replace(term, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    hit = F.rlike(text, F.concat(F.lit(r"(?<!\p{L})"), quoted, F.lit(r"(?!\p{L})")))
    return is_blank(term) | (text.contains(term) & hit)


def letter_runs(text: Column) -> Column:
    """Distinct maximal runs of letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)))


# The patterns below are fixed values: the wording of the provider's failure messages.
def classify_failure(stderr: Column, stdout: Column) -> Column:
    """Provider failure class of one run: code and cause."""
    both = F.concat(F.coalesce(stderr, F.lit("")), F.lit("\n"), F.coalesce(stdout, F.lit("")))
    # A bare 429 may be part of a path, a port or a name, so messages that name a cause go before it.
    limited = both.rlike(r"(?i)(rate limit|quota|too many requests|usage limit|\b(http(/[0-9.]+)?|status|code|error)[ \t:=]*429\b)")
    numbered = both.rlike(r"(?<![0-9])429(?![0-9])")
    session = F.regexp_extract(
        both, r"(?i)cannot access session files at (.+?) \(permission denied\)", 1
    )
    database = F.regexp_extract(both, r"(?i)failed to open state db at (.+?): .*readonly database", 1)
    lines = F.transform(F.split(both, "\n"), js_trim)
    thread = F.get(F.filter(lines, lambda l: l.startswith("Error: thread/start:")), 0)
    crash = F.lit("L10N_E0054")
    rate_limit = F.struct(F.lit("L10N_E0053").alias("code"), F.lit("rate_limit").alias("reason"),
                          F.lit(None).cast("string").alias("detail"))
    return (
        F.when(limited, rate_limit)
        .when(session != "", F.struct(crash.alias("code"), F.lit("session_files").alias("reason"),
                                      session.alias("detail")))
        .when(database != "", F.struct(crash.alias("code"), F.lit("state_database").alias("reason"),
                                       database.alias("detail")))
        .when(thread.isNotNull(), F.struct(crash.alias("code"), F.lit("thread_start").alias("reason"),
                                           thread.alias("detail")))
        .when(numbered, rate_limit)
        .otherwise(F.struct(crash.alias("code"), F.lit("exit").alias("reason"),
                            F.lit(None).cast("string").alias("detail")))
    )
