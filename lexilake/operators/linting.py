"""Key style and glossary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, explode_findings, finding
from lexilake.functions.keys import first_forbidden_prefix, key_matches_case, split_key
from lexilake.functions.text import contains_plural, contains_term, is_blank, letter_runs
from lexilake.session import durable, shuffled

RENAMEABLE = ["L10N_E0020", "L10N_E0021", "L10N_E0022", "L10N_E0023"]


def lint_keys(source: DataFrame, rules: DataFrame) -> DataFrame:
    """Up to five findings per key: style, depth, scope, forbidden prefix, plural syntax."""
    key, case = F.col("key"), F.col("key_case")
    judged = source.select("project", "key", "text").join(rules, "project").withColumns({
        "_segments": split_key(key, case),
        "_prefix": first_forbidden_prefix(key, F.col("forbidden_prefixes")),
    })
    scope, depth = F.get("_segments", 0), F.size("_segments")
    outside = (F.size("scopes") > 0) & (scope != "") & ~F.array_contains(F.col("scopes"), scope)
    return explode_findings(
        judged,
        F.when(~key_matches_case(key, case), finding("L10N_E0020", {"expected": case})),
        F.when(depth > F.col("max_depth"),
               finding("L10N_E0021", {"max_depth": F.col("max_depth"), "actual_depth": depth})),
        F.when(outside, finding("L10N_E0022", {"scope": scope, "scopes": F.array_join("scopes", ", ")})),
        F.when(F.col("_prefix").isNotNull(), finding("L10N_E0023", {"prefix": F.col("_prefix")})),
        F.when(contains_plural(F.col("text")), finding("L10N_E0042")),
    )


def renameable(diags: DataFrame) -> DataFrame:
    """Findings that a rename can cure."""
    return diags.filter(F.col("code").isin(RENAMEABLE) & (F.length("key") > 0))


def rename_candidates(diags: DataFrame, source: DataFrame) -> DataFrame:
    """Keys with curable findings and their sorted distinct codes."""
    per_key = renameable(diags).groupBy("project", "key").agg(
        F.array_sort(F.collect_set("code")).alias("violations"))
    return per_key.join(shuffled(source.select("project", "key", "text", "description")), ["project", "key"])


def _pieces(term):
    """Pieces that every text containing the term must hold as a whole: its letter runs.

    Letters may not touch the term, so each letter run inside it is a full run of the text.
    Terms without letters have their first character, blank terms the empty string.
    """
    runs = letter_runs(term)
    return F.when(is_blank(term), F.array(F.lit(""))).when(F.size(runs) > 0, runs).otherwise(F.array(F.substring(term, 1, 1)))


def lint_glossary(source: DataFrame, entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Translations that lose a glossary term their source text contains.

    Texts meet terms through an equi-join on anchors instead of a nested loop: of a term's pieces the one that the
    fewest texts hold.  Only keys and pieces are listed; texts join the few pairs that meet, for the whole-word test.
    """
    terms = glossary.filter(F.length("target_term") > 0)
    wanted = terms.select("project", "source_term").distinct().select(
        "project", "source_term", F.explode(_pieces(F.col("source_term"))).alias("piece"))
    # Single non-letters are anchors of letterless terms only.
    symbols = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\P{L})"), F.lit(1)))
    held = source.select("project", "key", F.explode(F.concat(letter_runs(F.col("text")), symbols, F.array(F.lit("")))).alias("piece"))
    hits = durable(held.join(wanted.select("project", "piece").distinct(), ["project", "piece"], "left_semi"))
    counts = hits.groupBy("project", "piece").agg(F.count(F.lit(1)).alias("n"))
    # A term with a piece that no text holds is in none.
    anchors = wanted.join(counts, ["project", "piece"], "left").groupBy("project", "source_term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("a")).filter("a.n > 0").select(
        "project", "source_term", F.col("a.piece").alias("piece"))
    used = hits.join(anchors, ["project", "piece"]).join(shuffled(source.select("project", "key", "text")), ["project", "key"]).filter(
        contains_term(F.col("text"), F.col("source_term"))).select("project", "key", "source_term")
    expected = used.join(
        terms.select("project", "source_term", "locale", "target_term"), ["project", "source_term"])
    lost = expected.join(
        shuffled(entries.select("project", "locale", "key", "text").filter(~is_blank(F.col("text")))),
        ["project", "locale", "key"],
    ).filter(~contains_term(F.col("text"), F.col("target_term")))
    return diagnose(lost, "L10N_E0087", {
        "source_term": F.col("source_term"), "expected_term": F.col("target_term")})
