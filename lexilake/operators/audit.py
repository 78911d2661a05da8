"""Checks of entries against source keys and of platform resources against the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, explode_findings, finding, shape, union_diagnostics
from lexilake.functions.text import canonical_placeholders, has_parity, is_blank, placeholder_signature
from lexilake.operators.planning import target_grid
from lexilake.operators.rows import removed_entries
from lexilake.session import shuffled


def configured(entries: DataFrame, locales: DataFrame) -> DataFrame:
    """Entries of the locales a project targets."""
    targets = locales.filter(~F.col("is_source")).select("project", "locale")
    return entries.join(targets, ["project", "locale"], "left_semi")


def _with_source(entries: DataFrame, source: DataFrame) -> DataFrame:
    s = source.select("project", "key", F.col("text").alias("source_text"),
                      F.col("source_hash").alias("expected_hash"))
    return entries.join(shuffled(s), ["project", "key"])


def check_missing(source: DataFrame, entries: DataFrame, locales: DataFrame) -> DataFrame:
    """Locales with no catalog at all, and the keys absent or blank in the others."""
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    have = entries.select("project", "locale").distinct()
    absent = targets.join(have, ["project", "locale"], "left_anti")
    present = targets.join(have, ["project", "locale"], "left_semi").withColumn("is_source", F.lit(False))
    filled = entries.filter(~is_blank(F.col("text"))).select("project", "locale", "key")
    gaps = target_grid(source.select("project", "key"), present).join(
        shuffled(filled), ["project", "locale", "key"], "left_anti")
    return union_diagnostics(diagnose(absent, "L10N_E0061"), diagnose(gaps, "L10N_E0063"))


def check_stale(source: DataFrame, entries: DataFrame) -> DataFrame:
    """Non-blank entries made from another version of their source key."""
    pairs = _with_source(entries.filter(~is_blank(F.col("text"))), source)
    return diagnose(pairs.filter(F.col("source_hash") != F.col("expected_hash")), "L10N_E0064", {
        "expected_source_hash": F.col("expected_hash"), "actual_source_hash": F.col("source_hash")})


def check_placeholders(source: DataFrame, entries: DataFrame) -> DataFrame:
    """Non-blank entries, stale ones too, whose placeholders differ from the source."""
    pairs = _with_source(entries.filter(~is_blank(F.col("text"))), source)
    return diagnose(pairs.filter(~has_parity(F.col("source_text"), F.col("text"))), "L10N_E0041")


def check_entries(source: DataFrame, entries: DataFrame) -> DataFrame:
    """:func:`check_stale` and :func:`check_placeholders` in one join."""
    pairs = _with_source(entries.filter(~is_blank(F.col("text"))), source)
    return explode_findings(
        pairs,
        F.when(F.col("source_hash") != F.col("expected_hash"), finding("L10N_E0064", {
            "expected_source_hash": F.col("expected_hash"), "actual_source_hash": F.col("source_hash")})),
        F.when(~has_parity(F.col("source_text"), F.col("text")), finding("L10N_E0041")))


def check_orphans(entries: DataFrame, source: DataFrame) -> DataFrame:
    return diagnose(removed_entries(entries, source), "L10N_E0065")


def orphaned_reviewed(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Reviewed entries whose key left the source; worth keeping in an archive."""
    return removed_entries(entries.filter("reviewed"), source)


def sync_gate(entries: DataFrame, source: DataFrame) -> DataFrame:
    """What must be settled before a run may write.

    Current entries must agree with the source's placeholders.  Reviewed entries that fell
    behind are left alone with a warning, or block the run once their placeholders diverge.
    """
    parity = has_parity(F.col("source_text"), F.col("text"))
    current = F.col("source_hash") == F.col("expected_hash")
    return explode_findings(
        _with_source(entries, source),
        F.when(current & ~is_blank(F.col("text")) & ~parity, finding("L10N_E0041")),
        F.when(F.col("reviewed") & ~current & parity, finding("L10N_E0090")),
        F.when(F.col("reviewed") & ~current & ~parity, finding("L10N_E0082")))


def canonical_entries(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Entries with the placeholders their text uses, then the declared ones it leaves out."""
    s = source.select("project", "key", F.col("placeholders").alias("_declared"))
    none = F.create_map().cast("map<string,struct<example:string,type:string>>")
    return entries.join(shuffled(s), ["project", "key"], "left").withColumn(
        "placeholders", canonical_placeholders(F.col("text"), F.coalesce("_declared", none))).drop("_declared")


def canonical_source(source: DataFrame, source_locale: str = "en") -> DataFrame:
    """Source keys in the platform-neutral shape, descriptions as comments."""
    return source.select(
        "project", F.lit(source_locale).alias("locale"), "key", "text",
        F.nullif("description", F.lit("")).alias("comment"),
        canonical_placeholders(F.col("text"), F.col("placeholders")).alias("placeholders"))


def expected_platform(source: DataFrame, entries: DataFrame, platforms: DataFrame,
                      source_locale: str = "en") -> DataFrame:
    """What each configured platform should hold: source rows and every translation."""
    translated = canonical_entries(entries, source).select("project", "locale", "key", "text", "placeholders")
    rows = canonical_source(source, source_locale).drop("comment").unionByName(translated)
    return rows.join(platforms.select("project", "platform"), "project")


def platform_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys a platform lacks, holds in other words or with other placeholders, or has too many of."""
    at = ["project", "platform", "locale", "key"]
    e = expected.select(*at, F.col("text").alias("_text"),
                        placeholder_signature(F.col("placeholders")).alias("_signature"))
    a = actual.select(*at, F.col("text").alias("_actual"),
                      placeholder_signature(F.col("placeholders")).alias("_actual_signature"))
    both = F.col("_text").isNotNull() & F.col("_actual").isNotNull()
    details = {"platform": F.col("platform")}
    return explode_findings(
        e.join(a, at, "full_outer"),
        F.when(F.col("_actual").isNull(), finding("L10N_E0066", details)),
        F.when(both & (F.col("_text") != F.col("_actual")), finding("L10N_E0067", details)),
        F.when(both & (F.col("_signature") != F.col("_actual_signature")), finding("L10N_E0041", details)),
        F.when(F.col("_text").isNull(), finding("L10N_E0068", details)))


def audit_keys(source: DataFrame, entries: DataFrame, locales: DataFrame, platforms: DataFrame | None = None,
               platform_entries: DataFrame | None = None, source_locale: str = "en") -> DataFrame:
    """All findings about entries and platform rows in one pass: missing, stale, placeholders, orphans and drift.

    Source keys, entries of configured locales and platform rows are dealt by project and key once and meet in one
    grouping; a key's rows are as few as its project has locales and platforms.  Each is then judged in the row of its
    key.  The findings are those of ``check_missing``, ``check_entries``, ``check_orphans`` and ``platform_drift``.
    """
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    have = entries.select("project", "locale").distinct()
    absent = targets.join(have, ["project", "locale"], "left_anti")
    wanted = targets.join(have, ["project", "locale"], "left_semi").groupBy("project").agg(F.collect_list("locale").alias("targets"))
    drift = platforms is not None and platform_entries is not None
    held = platforms.groupBy("project").agg(F.collect_set("platform").alias("platforms")) if drift else None

    def tagged(df: DataFrame, **parts) -> DataFrame:
        empty = {"src": "struct<text:string,hash:string,types:map<string,struct<example:string,type:string>>>",
                 "ent": "struct<locale:string,text:string,hash:string>", "plat": "struct<platform:string,locale:string,text:string,signature:string>"}
        return df.select("project", "key", *[
            (parts[n] if n in parts else F.lit(None)).cast(kind).alias(n) for n, kind in empty.items()])

    rows = tagged(source, src=F.struct(F.col("text"), F.col("source_hash"), F.col("placeholders"))).unionByName(
        tagged(configured(entries, locales), ent=F.struct("locale", "text", "source_hash")))
    if drift:
        rows = rows.unionByName(tagged(platform_entries, plat=F.struct(
            "platform", "locale", "text", placeholder_signature(F.col("placeholders")))))
    keys = rows.groupBy("project", "key").agg(
        F.first("src", ignorenulls=True).alias("src"), F.collect_list("ent").alias("ents"), F.collect_list("plat").alias("plats"))
    none = F.array().cast("array<string>")
    keys = keys.join(wanted, "project", "left").withColumn("targets", F.when(
        F.col("src").isNotNull(), F.coalesce("targets", none)).otherwise(none))
    keys = keys.join(held, "project", "left") if drift else keys.withColumn("platforms", none)
    seen = F.array_distinct(F.concat(
        "targets", F.transform("ents", lambda e: e["locale"]), F.transform("plats", lambda p: p["locale"]),
        F.when(F.col("src").isNotNull() & F.lit(drift), F.array(F.lit(source_locale))).otherwise(none)))
    cells = keys.select("*", F.explode(seen).alias("locale")).select(
        "project", "key", "locale", "src", F.get(F.filter("ents", lambda e: e["locale"] == F.col("locale")), 0).alias("ent"),
        F.filter("plats", lambda p: p["locale"] == F.col("locale")).alias("plats"), F.coalesce("platforms", none).alias("platforms"),
        F.array_contains("targets", F.col("locale")).alias("wanted"))
    text, source_text = F.col("ent.text"), F.col("src.text")
    filled = F.col("ent").isNotNull() & ~is_blank(text)
    known = filled & F.col("src").isNotNull()
    about_entries = [
        F.when(F.col("wanted") & ~filled, finding("L10N_E0063")),
        F.when(known & (F.col("ent.hash") != F.col("src.hash")), finding("L10N_E0064", {
            "expected_source_hash": F.col("src.hash"), "actual_source_hash": F.col("ent.hash")})),
        F.when(known & ~has_parity(source_text, text), finding("L10N_E0041")),
        F.when(F.col("ent").isNotNull() & F.col("src").isNull(), finding("L10N_E0065"))]
    if not drift:
        return union_diagnostics(diagnose(absent, "L10N_E0061"), explode_findings(cells, *about_entries))
    is_source = F.col("locale") == source_locale
    declared = F.coalesce("src.types", F.create_map().cast("map<string,struct<example:string,type:string>>"))
    # The source's own row is what its locale should hold, but for a catalog of that locale.
    said = F.when(F.col("ent").isNotNull(), text).when(is_source, source_text)
    judged = cells.withColumn("_text", said).withColumn(
        "_signature", placeholder_signature(canonical_placeholders(F.col("_text"), declared)))

    def of_platform(name: Column) -> list[Column]:
        actual = F.get(F.filter("plats", lambda p: p["platform"] == name), 0)
        expected = F.col("_text").isNotNull() & F.array_contains("platforms", name)
        details = {"platform": name}
        both = expected & actual.isNotNull()
        return [F.when(expected & actual.isNull(), finding("L10N_E0066", details)),
                F.when(both & (F.col("_text") != actual["text"]), finding("L10N_E0067", details)),
                F.when(both & (F.col("_signature") != actual["signature"]), finding("L10N_E0041", details)),
                F.when(~expected & actual.isNotNull(), finding("L10N_E0068", details))]

    names = F.array_distinct(F.concat("platforms", F.transform("plats", lambda p: p["platform"])))
    about_platforms = F.flatten(F.transform(names, lambda name: F.array(*of_platform(name))))
    found = F.filter(F.concat(F.array(*about_entries), about_platforms), lambda f: f.isNotNull())
    return union_diagnostics(diagnose(absent, "L10N_E0061"), shape(judged.select(
        "project", "locale", "key", F.explode(found).alias("f")).select("project", "locale", "key", "f.code", "f.level", "f.details")))


def missing_platforms(platforms: DataFrame, resources: DataFrame) -> DataFrame:
    """Configured platforms (project, platform) of which ``resources`` (project, platform) has nothing."""
    gone = platforms.select("project", "platform").distinct().join(
        resources.select("project", "platform").distinct(), ["project", "platform"], "left_anti")
    return diagnose(gone, "L10N_E0030", {"platform": F.col("platform")})


def archived_warnings(archived: DataFrame) -> DataFrame:
    """One warning per reviewed entry that went to the archive."""
    return shape(diagnose(archived, "L10N_E0083", {"archive_path": F.col("archive_name")}))
