"""Key renames: single, batch, validation, and rewriting of references in text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, shape, union_diagnostics
from lexilake.operators.linting import lint_keys, renameable
from lexilake.session import durable, forget, shuffled


def rename_key(df: DataFrame, project: int, from_: str, to: str) -> DataFrame:
    """Rename one key of one project in any table with a ``key`` column."""
    hit = (F.col("project") == project) & (F.col("key") == from_)
    return df.withColumn("key", F.when(hit, F.lit(to)).otherwise(F.col("key")))


def rename_conflicts(source: DataFrame, project: int, from_: str, to: str) -> DataFrame:
    """Findings that forbid a single rename: the source key is unknown, or the target is taken."""
    present = source.filter(F.col("project") == project).agg(
        F.coalesce(F.bool_or(F.col("key") == from_), F.lit(False)).alias("known"),
        F.coalesce(F.bool_or(F.col("key") == to), F.lit(False)).alias("taken"))
    rows = present.select(F.explode(F.array(
        F.struct(F.lit(from_).alias("key"), (~F.col("known")).alias("bad")),
        F.struct(F.lit(to).alias("key"), F.col("taken").alias("bad")))).alias("c")).filter("c.bad")
    return diagnose(rows.select(F.lit(project).alias("project"), "c.key"), "L10N_E0069")


def planned_renames(plan: DataFrame) -> DataFrame:
    """Plan rows that name a destination."""
    return plan.filter(F.length("to_key") > 0)


def apply_renames(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rename keys of any table with ``project`` and ``key`` by a plan."""
    renames = planned_renames(plan).select("project", F.col("from_key").alias("key"), F.col("to_key").alias("_to"))
    return df.join(shuffled(renames), ["project", "key"], "left").withColumn(
        "key", F.coalesce("_to", "key")).select(*df.columns)


def validate_renames(plan: DataFrame, source: DataFrame, rules: DataFrame,
                     candidates: DataFrame) -> DataFrame:
    """Everything wrong with a rename plan; empty means it may be applied."""
    renames = planned_renames(plan).select("project", "from_key", "to_key")
    keys = source.select("project", "key")
    froms = renames.select("project", F.col("from_key").alias("key"))
    remaining = keys.join(shuffled(froms), ["project", "key"], "left_anti")
    by_to = renames.withColumnRenamed("to_key", "key")

    undecided = candidates.select("project", "key").join(
        shuffled(plan.select("project", F.col("from_key").alias("key"), "to_key", "skip_reason")),
        ["project", "key"], "left").filter(F.coalesce(F.length("to_key"), F.lit(0)) == 0)
    unknown = froms.join(shuffled(keys), ["project", "key"], "left_anti")
    noop = renames.filter(F.col("from_key") == F.col("to_key")).withColumnRenamed("from_key", "key")
    collides = by_to.join(shuffled(remaining), ["project", "key"], "left_semi")
    repeated = by_to.groupBy("project", "key").count().filter(F.col("count") > 1).select("project", "key")
    doubled = by_to.join(shuffled(repeated), ["project", "key"], "left_semi")

    destinations = by_to.select("project", "key").distinct()
    renamed = apply_renames(keys, plan).distinct().join(shuffled(destinations), ["project", "key"], "left_semi")
    still_bad = renameable(lint_keys(renamed.withColumn("text", F.lit("")), rules))
    return union_diagnostics(
        diagnose(undecided, "L10N_E0072", {"reason": F.col("skip_reason")}),
        diagnose(unknown, "L10N_E0073"),
        diagnose(noop, "L10N_E0074"),
        diagnose(collides, "L10N_E0075", {"from": F.col("from_key")}),
        diagnose(doubled, "L10N_E0076", {"from": F.col("from_key")}),
        shape(still_bad.withColumn("details", F.map_concat(
            F.coalesce("details", F.create_map().cast("map<string,string>")),
            F.create_map(F.lit("violation"), F.col("code")))).withColumn("code", F.lit("L10N_E0077"))))


# Stand-ins for keys already replaced: private-use characters, so that no key matches inside one.
_OPEN, _MARK, _CLOSE = "\uE000", "\uE001", "\uE002"
_TOKEN_CHARACTERS = "A-Za-z0-9_.-"


# Long runs are cut into overlapping segments of this many characters before positions are listed.
_SEGMENT = 1024


# Keys are found by substrings of one of these lengths: of each key the longest that it holds.
_GRAMS = (1, 2, 4, 8)


def _gram_size(text) -> F.Column:
    """The length of the substrings that a key is found by."""
    size = F.lit(_GRAMS[0])
    for n in _GRAMS[1:]:
        size = F.when(F.length(text) >= n, n).otherwise(size)
    return size


def _plan_shape(renames: DataFrame) -> tuple[str, int, int, list[int]]:
    """Characters of the keys to replace, their least and greatest length, and the lengths of their substrings."""
    row = renames.select("from_key", F.explode(F.array_distinct(F.split("from_key", ""))).alias("c")).agg(
        F.collect_set("c").alias("chars"), F.min(F.length("from_key")).alias("least"),
        F.max(F.length("from_key")).alias("most"), F.collect_set(_gram_size("from_key")).alias("sizes")).first()
    return ("".join(f"\\x{{{ord(c):x}}}" for c in sorted(row["chars"]) if c), row["least"] or 0, row["most"] or 0,
            sorted(row["sizes"]))


def _grams_of(text, size: int) -> F.Column:
    """The distinct substrings of a length, cut in one pass of an expression."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _keys_inside(runs: DataFrame, renames: DataFrame, least: int, most: int, sizes: list[int]) -> DataFrame:
    """(project, run_id, from_key): the keys that occur anywhere in each run.

    Runs are cut into segments that overlap by the longest key.  Of all substrings of a key of its length class the
    one that the fewest segments hold is its anchor; segments meet keys on anchors alone, and what meets is compared
    as a whole.  So a short key among many long ones costs a row for each segment that holds it and nothing else, and
    a beginning that all keys share is nobody's anchor.  A key with a substring that no segment holds is nowhere.

    Substrings are counted where they are cut, and only their counts are shuffled; they move once, to meet the anchors.
    """
    # One pass of an expression cuts a run; taking substrings by position would scan it again for each.
    piece = F.lit(f"(?s)(.{{1,{_SEGMENT}}})(?=(.{{0,{most - 1}}}))")
    own, ahead = (F.regexp_extract_all("run", piece, F.lit(group)) for group in (1, 2))
    segments = durable(runs.filter(F.length("run") >= least).select("project", "run_id", F.explode(
        F.zip_with(own, ahead, lambda a, b: F.concat(a, b))).alias("segment")).filter(F.length("segment") >= least).withColumn(
        "segment_id", F.monotonically_increasing_id()))
    size = _gram_size("from_key")
    of_keys = F.lit(None).cast("array<string>")
    for n in sizes:
        of_keys = F.when(size == n, _grams_of(F.col("from_key"), n)).otherwise(of_keys)
    keyed = renames.select("project", "from_key", F.explode(of_keys).alias("gram"))
    held = segments.select("project", "segment_id", F.explode(F.concat(*[_grams_of(F.col("segment"), n) for n in sizes])).alias("gram"))
    counts = held.groupBy("project", "gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = durable(keyed.join(shuffled(counts), ["project", "gram"], "left").groupBy("project", "from_key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")).filter("a.n > 0").select(
        "project", "from_key", F.col("a.gram").alias("gram")))
    met = held.join(shuffled(anchors), ["project", "gram"]).select("project", "segment_id", "from_key")
    found = durable(met.join(shuffled(segments), ["project", "segment_id"]).filter(F.contains("segment", F.col("from_key"))).select(
        "project", "run_id", "from_key").distinct())
    forget(segments, anchors)
    return found


def _rewrite_run(run, matches):
    """New text of a run and the number of replacements: longest key first, no chaining."""
    start = F.struct(run.alias("text"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("i"))

    def hide(acc, m):
        gone = F.length(acc["text"]) - F.length(F.replace(acc["text"], m["from_key"], F.lit("")))
        stand_in = F.concat(F.lit(_OPEN), F.repeat(F.lit(_MARK), acc["i"]), F.lit(_CLOSE))
        return F.struct(
            F.replace(acc["text"], m["from_key"], stand_in).alias("text"),
            (acc["n"] + F.floor(gone / F.length(m["from_key"])).cast("bigint")).alias("n"),
            (acc["i"] + 1).alias("i"))

    hidden = F.aggregate(matches, start, hide)

    def show(acc, m):
        stand_in = F.concat(F.lit(_OPEN), F.repeat(F.lit(_MARK), acc["i"]), F.lit(_CLOSE))
        return F.struct(F.replace(acc["text"], stand_in, m["to_key"]).alias("text"),
                        acc["n"].alias("n"), (acc["i"] + 1).alias("i"))

    begun = F.struct(hidden["text"].alias("text"), hidden["n"].alias("n"), F.lit(0).alias("i"))
    return F.aggregate(matches, begun, show)


def bulk_reference_rewrite(corpus: DataFrame, plan: DataFrame, whole_token: bool = False) -> DataFrame:
    """Rewrite key references in texts: longest key first, no rename feeds another.

    Keys match as bare substrings unless ``whole_token``.  Returns changed texts only, with the
    number of replacements.

    A key can only occur inside an unbroken run of characters that keys are made of, so the
    work is done once per distinct run of the corpus: its segments meet the plan in an
    equi-join on the rarest part of a key.  Neither the plan nor the corpus passes through the driver or a
    broadcast.  ``corpus`` has project, path (unique in its project) and text.
    """
    renames = durable(planned_renames(plan).filter(F.length("from_key") > 0).groupBy("project", "from_key").agg(
        F.max("to_key").alias("to_key")))
    characters, least, most, sizes = _plan_shape(renames)
    texts = corpus.filter(~F.contains("text", F.lit("\x00")))
    if not least:
        return texts.limit(0).withColumn("replacements", F.lit(0).cast("bigint"))
    pattern = f"[{_TOKEN_CHARACTERS if whole_token else ''}{characters}]+"
    runs_of = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    at = ["project", "path"]

    mentions = texts.select(*at, F.explode(F.array_distinct(runs_of)).alias("run")).filter(
        F.length("run") >= least)
    # Stored once, with short numbers for the joins that follow.
    runs = durable(mentions.select("project", "run").distinct().withColumn("run_id", F.monotonically_increasing_id()))
    if whole_token:
        parts = runs.select("project", "run_id", F.col("run").alias("from_key"))
    else:
        parts = _keys_inside(runs, renames, least, most, sizes)
    longest_first = F.array_sort(F.collect_list(F.struct(
        (-F.length("from_key")).alias("_size"), "from_key", "to_key")))
    rewritten = (
        parts.join(shuffled(renames), ["project", "from_key"])
        .groupBy("project", "run_id").agg(longest_first.alias("_matches"))
        .join(shuffled(runs), ["project", "run_id"])
        .withColumn("_new", _rewrite_run(F.col("run"), F.col("_matches")))
        .select("project", "run", F.col("_new.text").alias("new_run"), F.col("_new.n").alias("hits")))
    # Per text a map of the changed runs it mentions, which is smaller than the text itself.
    changes = mentions.join(shuffled(rewritten), ["project", "run"]).groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("run", F.struct("new_run", "hits")))).alias("_changes"))
    runs_in_text, gaps = F.col("_runs"), F.split("text", pattern, -1)
    new_text = F.array_join(F.zip_with(
        gaps, F.transform(runs_in_text, lambda r: F.coalesce(F.try_element_at("_changes", r)["new_run"], r)),
        lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    hits = F.aggregate(runs_in_text, F.lit(0).cast("bigint"),
                       lambda n, r: n + F.coalesce(F.try_element_at("_changes", r)["hits"], F.lit(0).cast("bigint")))
    return texts.join(shuffled(changes), at).withColumn("_runs", runs_of).withColumns(
        {"_text": new_text, "replacements": hits}).filter(F.col("_text") != F.col("text")).select(
        *[F.col("_text").alias("text") if c == "text" else F.col(c) for c in corpus.columns], "replacements")


def rename_report(entries_before: DataFrame, plan: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Locales touched, reference files changed and replacements made, per project."""
    froms = planned_renames(plan).select("project", F.col("from_key").alias("key"))
    touched = entries_before.join(shuffled(froms), ["project", "key"], "left_semi").groupBy("project").agg(
        F.count_distinct("locale").alias("locales_touched"))
    files = rewritten.groupBy("project").agg(
        F.count(F.lit(1)).alias("reference_files"), F.sum("replacements").alias("replacements"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("locales_touched", "reference_files", "replacements")]
    return touched.join(files, "project", "full_outer").select("project", *zero)
