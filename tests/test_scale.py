"""Operators that must not depend on how rows are spread, each against brute force."""

import itertools
import random
import re

import pytest
import rows as t
from lexilake import schemas
from lexilake.operators import audit, cache, coverage, merging, near, planning, ranking, renaming, rows, similarity_join
from lexilake.operators.dedupe import exact_duplicates
from lexilake.session import durable
from lexilake.sinks import catalogs, documents, reports
from lexilake.sources import catalogs as source_catalogs
from pyspark.sql import functions as F
from pyspark.sql import Window


def test_rank_of_a_group_larger_than_a_partition(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("project"),
        F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = ranking.grouped_rank(df.repartition(13), ["project"], [F.col("key")], total="total")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("key")).cast("bigint")).withColumn(
        "total", F.count("*").over(Window.partitionBy("project")))
    assert sorted(map(tuple, got.select("project", "key", "rank", "total").collect())) == sorted(map(tuple, want.collect()))


def test_tables_of_keys_are_not_broadcast(spark):
    """However small their files look, and so at every size."""
    src = durable(t.source(spark, [("a", "x", None, {}), ("b", "y", None, {})]))
    ent = durable(t.entries(spark, src, [("de", "a", "x", True, False), ("de", "c", "y", True, True)]))
    loc, con = t.locales(spark, ["de"]), t.configs(spark)
    kept = durable(spark.createDataFrame([], schemas.CACHE))
    for df in (audit.check_stale(src, ent), audit.sync_gate(ent, src), rows.refresh_stale_flags(ent, src), rows.live_entries(ent, src),
               coverage.locale_coverage(src, ent, loc), cache.gc_cache(kept, src), audit.canonical_entries(ent, src),
               planning.plan_sync(src, ent, loc, kept, con)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin) (\[[^\]]*\])", plan)
        assert any(kind == "SortMergeJoin" for kind, _ in joins)
        assert not [on for kind, on in joins if kind.startswith("Broadcast") and re.search(r"\b(key|source_hash)#", on)]


def test_nodes_of_documents_are_not_broadcast(spark):
    side = durable(spark.createDataFrame([(0, "d", ["a"], "leaf", "1"), (0, "d", ["b"], "leaf", "2")],
                                         "project int, doc string, path array<string>, kind string, value string").withColumn(
        "v", F.parse_json("value")))
    other = durable(side.withColumn("value", F.lit("3")))
    merged, conflicts = merging.merge_catalogs(side, other, ["project", "doc"])
    for df in (merged, conflicts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert merged.count() == 0 and [tuple(r) for r in conflicts.collect()] == [(0, "d", "a")]


def test_findings_are_made_once_for_their_numbers(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(i):
        made.add(1)
        return f"k{i:03d}"

    diags = spark.range(0, 200, 1, 4).select(
        F.lit(0).alias("project"), F.lit("L10N_E0063").alias("code"), F.lit("error").alias("level"), F.lit("de").alias("locale"),
        key("id").alias("key"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("map<string,string>").alias("details"))
    got = reports.numbered_findings(diags)
    assert sorted((r.position, r.key) for r in got.collect()) == [(i + 1, f"k{i:03d}") for i in range(200)]
    assert made.value == 200


def test_fragments_are_not_dealt_to_find_their_last(spark, tmp_path, monkeypatch):
    """A join by document for the separators shuffled every fragment once more."""
    plans = []
    monkeypatch.setattr(documents, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    src = durable(t.source(spark, [("a", "x", None, {}), ("b", "y", None, {}), ("c", "z", None, {})]))
    monkeypatch.setattr(documents, "FEW_DOCUMENTS", 0)
    for at in ("many", "few"):
        catalogs.write_sources(src, str(tmp_path / at), parts=3)
        assert plans and "Join" not in plans[0]
        plans.clear()
        monkeypatch.setattr(documents, "FEW_DOCUMENTS", 10)
        parts = sorted((tmp_path / at).glob("project=*/locale=*/part=*"), key=lambda p: int(p.name[5:]))
        lines = "".join(f.read_text() for p in parts for f in sorted(p.glob("part-*")))
        want = "\n".join(r.fragment for r in catalogs.render_source(src).orderBy("section", "sort_key").collect()) + "\n"
        assert lines == want


def rewrite(text, renames):
    """Longest key first, stand-ins so that no rename feeds another."""
    count, hidden = 0, []
    for i, (old, new) in enumerate(sorted(renames, key=lambda r: (-len(r[0]), r[0]))):
        mark = chr(0xF000 + i)
        count += text.count(old)
        text = text.replace(old, mark)
        hidden.append((mark, new))
    for mark, new in hidden:
        text = text.replace(mark, new)
    return text, count


def test_rewrite_equals_brute_force(spark):
    rng = random.Random(7)
    letters = ["a", "b", ".", "c1", "_"]
    names = sorted({"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(40)})
    renames = [(n, rng.choice(names) + "X") for n in names if rng.random() < 0.6] + [("say hi", "say ho")]
    texts = ["".join(rng.choices([*letters, " ", "\n", "(", "z", "say hi"], k=60)) for _ in range(120)] + ["a.b a.bc c a.b", "nothing", "x\x00a"]
    corpus = spark.createDataFrame([(i % 2, f"p{i}", x) for i, x in enumerate(texts)], "project int, path string, text string")
    plan = spark.createDataFrame([(0, a, b) for a, b in renames], "project int, from_key string, to_key string")
    got = {(r.project, r.path): (r.text, r.replacements) for r in renaming.bulk_reference_rewrite(corpus, plan).collect()}
    want = {}
    for i, x in enumerate(texts):
        if i % 2 == 0 and "\x00" not in x:
            new, n = rewrite(x, renames)
            if n and new != x:
                want[(0, f"p{i}")] = (new, n)
    assert got == want


def test_rewrite_inside_a_long_run(spark):
    """Keys that start at the end of a segment, cross it or end the run are found."""
    from lexilake.operators.renaming import _SEGMENT

    run = list("z" * (3 * _SEGMENT + 7))
    for at in (0, _SEGMENT - 1, 2 * _SEGMENT - 3, 3 * _SEGMENT + 2):
        run[at:at + 5] = "a.b.c"
    corpus = spark.createDataFrame([(0, "p", "".join(run))], "project int, path string, text string")
    plan = spark.createDataFrame([(0, "a.b.c", "n", None, None), (0, "q" * 40, "m", None, None)],
                                 "project int, from_key string, to_key string, rationale string, skip_reason string")
    row = renaming.bulk_reference_rewrite(corpus, plan).first()
    assert (row.text, row.replacements) == ("".join(run).replace("a.b.c", "n"), 4)


def test_rewrite_stores_no_substrings_and_moves_short_ids(spark, monkeypatch):
    """A row for each substring of each run, with a hash of the run, was stored and moved several times."""
    stored = []
    monkeypatch.setattr(renaming, "durable", lambda df: stored.append(dict(df.dtypes)) or durable(df))
    corpus = spark.createDataFrame([(0, "a", "see home.title.k1 and home.title.k12"), (0, "b", "home.title.k1")], "project int, path string, text string")
    plan = spark.createDataFrame([(0, "home.title.k1", "x"), (0, "home.title.k12", "y")], "project int, from_key string, to_key string")
    got = {r.path: (r.text, r.replacements) for r in renaming.bulk_reference_rewrite(corpus, plan).collect()}
    assert got == {"a": ("see x and y", 2), "b": ("x", 1)}
    assert {t["run_id"] for t in stored if "run_id" in t} == {"bigint"}
    assert not [t for t in stored if "gram" in t and "from_key" not in t]


def test_rewrite_does_not_chain_and_can_match_tokens(spark):
    corpus = spark.createDataFrame([(0, "f", "a.b a.bc c a.b")], "project int, path string, text string")
    plan = spark.createDataFrame([(0, "a.bc", "c"), (0, "a.b", "a.bc")], "project int, from_key string, to_key string")
    row = renaming.bulk_reference_rewrite(corpus, plan).first()
    assert (row.text, row.replacements) == ("a.bc c c a.bc", 3)
    short = spark.createDataFrame([(0, "a.b", "n")], "project int, from_key string, to_key string")
    assert renaming.bulk_reference_rewrite(corpus, short).first().text == "n nc c n"
    assert renaming.bulk_reference_rewrite(corpus, short, whole_token=True).first().text == "n a.bc c n"
    assert renaming.bulk_reference_rewrite(corpus, short.limit(0)).count() == 0


def words(rng, n):
    return [f"w{rng.randint(0, 4000)}" for _ in range(n)]


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {text}


def components(keys, links):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {k: find(k) for k in keys}


def test_near_duplicates_against_all_pairs(spark):
    """A hot family holds over a third of the texts, each different; others are pairs and singles."""
    rng = random.Random(3)
    base, texts = words(rng, 120), {}
    for i in range(60):
        copy = list(base)
        copy[rng.randint(40, 119)] = f"u{i}"
        texts[f"hot{i:03d}"] = " ".join(copy)
    for i in range(30):
        body = words(rng, 90)
        texts[f"pair{i:03d}a"] = " ".join(body)
        texts[f"pair{i:03d}b"] = " ".join([*body[:-1], "end"])
    for i in range(20):
        texts[f"solo{i:03d}"] = " ".join(words(rng, 50))
    texts["tiny1"], texts["tiny2"] = "ok", "ok"
    texts["copy"] = texts["pair000a"]
    sets = {k: shingle_set(v) for k, v in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2)
             if texts[a] != texts[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7]
    exact = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] == texts[b]]
    root = components(texts, links + exact)
    linked = {root[k] for pair in links for k in pair}
    want = {(root[k], k) for k in texts if root[k] in linked and root[k] != k}
    df = spark.createDataFrame([(0, k, v) for k, v in texts.items()], "project int, key string, text string").repartition(7)
    got = {(r.canonical_key, r.duplicate_key): r.confidence for r in near.near_duplicates(df, 0.7).collect()}
    assert set(got) == want
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    least = {r: min(like(r, k) for k in texts if root[k] == r) for r, _ in want}
    assert got == {(r, k): pytest.approx(least[r]) for r, k in want}


@pytest.mark.parametrize("listed,block", [(64, 256), (3, 4)])
def test_set_join_is_exact(spark, monkeypatch, listed, block):
    """Chains, families around one text, sets alike through a common passage and below, in two projects."""
    monkeypatch.setattr(similarity_join, "LISTED", listed)
    monkeypatch.setattr(similarity_join, "BLOCK", block)
    rng = random.Random(7)
    sets = {"a": {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}, "b": {1, 2, 3, 4, 5, 6, 7, 8, 9, 11}, "c": {1, 2, 3, 4, 5, 6, 7, 8, 12, 11}, "e": set()}
    passage = list(range(100, 140))
    for i in range(80):
        sets[f"p{i:02}"] = {*passage, *rng.sample(range(1000, 9000), rng.choice([12, 16, 18, 22]))}
    for i in range(20):
        sets[f"q{i:02}"] = {*list(sets[f"p{i:02}"])[:-2], 20000 + i}
    for i in range(120):
        sets[f"r{i:03}"] = set(rng.sample(range(40), rng.randint(1, 14)))
    for share in ((7, 10), (4, 5), (1, 2)):
        links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
                 if sets[a] & sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])]
        want = {(p, k, r) for p in (0, 1) for k, r in components(sets, links).items() if k != r}
        df = spark.createDataFrame([(p, k, sorted(s)) for p in (0, 1) for k, s in sets.items()], "project int, key string, elements array<bigint>")
        got = similarity_join.alike_components(df.repartition(5), share)
        assert {(r.project, r.key, r.component) for r in got.collect()} == want
    assert similarity_join.alike_components(df.limit(0), (1, 2)).count() == 0


def test_long_lists_without_a_possible_pair_are_not_compared(spark, monkeypatch):
    """Sets that share eight of ten elements are unlike; the element they meet on comes too late in each for a pair."""
    common = list(range(1, 8))
    sets = [(0, f"a{i:03d}", [0, 1000 + 2 * i, 1001 + 2 * i] + common) for i in range(100)]
    sets += [(0, f"b{i:03d}", [5000 + 4 * i + j for j in range(4)] + common) for i in range(50)]
    df = durable(spark.createDataFrame(sets, "project int, key string, elements array<bigint>"))

    def cells(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(similarity_join, "_cells", cells)
    assert similarity_join.alike_components(df, (7, 10)).count() == 0
    prefix = similarity_join.prefixes(df, (7, 10))
    assert {(r.element, r.n, r.place) for r in prefix.collect()} == {(0, 10, 2), (1, 10, 3)} and prefix.count() == 200
    plan = prefix._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(0, f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [(0, "s00", f"s{i:02d}") for i in range(1, 30)] + [(1, "n00", "n09")]
    got = near.connected_components(spark.createDataFrame(edges, "project int, a string, b string")).collect()
    assert {(r.project, r.key): r.component for r in got} == {
        **{(0, f"n{i:02d}"): "n00" for i in range(1, 21)}, **{(0, f"s{i:02d}"): "s00" for i in range(1, 30)}, (1, "n09"): "n00"}


def test_exact_duplicates_stay_long_for_a_hot_text(spark):
    df = spark.range(3000).select(F.lit(0).alias("project"), F.format_string("k%05d", "id").alias("key"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(df).collect()
    assert len(got) == 1000 and {r.canonical_key for r in got} == {"k00000"} and {r.n for r in got} == {1000}


def test_versions_are_dealt_by_key_before_they_are_compared(spark):
    """No task sorts its share of the scan, and parts are spread whatever the size of their file."""
    from contract.views import Lake

    lake = Lake(spark, "/root/testdata/sf0.001")
    plan = lake.entries._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Aggregate") < plan.index("RepartitionByExpression [pk")
    files = lake.parts.inputFiles()
    assert len(files) > 1


def test_documents_are_written_from_what_tasks_read(spark, tmp_path):
    """Stored ranges are not dealt again; a range whose file is read by many tasks has many parts, in order."""
    src = t.source(spark, [(f"k{i:05}", f"text {i} " + "x" * 50, None, {}) for i in range(3000)])
    for name, value in (("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        catalogs.write_sources(src, str(tmp_path / "c"), parts=3)
        plan = documents._parts_as_read(spark.read.parquet(str(tmp_path / "c" / "_manifest")))._jdf.queryExecution().toString()
        parts = spark.read.parquet(str(tmp_path / "c" / "_manifest")).orderBy("part").collect()
        rows, bad = source_catalogs.read_source_catalogs(spark, str(tmp_path / "c"))
        assert bad.isEmpty() and rows.count() == 3000
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    keys = [(p.first_key, p.last_key) for p in parts if p.first_key]
    assert sum(p.fragments for p in parts) == 3002 and all(a[1] < b[0] for a, b in zip(keys, keys[1:]))
    files = {f.parent.name: f for f in (tmp_path / "c").rglob("part-*.txt")}
    assert len(files) == len(parts) == len(list((tmp_path / "c").rglob("part-*.txt")))


def test_a_plan_deals_out_keys_and_no_grid(spark):
    """The grid of keys and locales, and the texts of entries, were shuffled to meet."""
    src = durable(t.source(spark, [("a", "x", None, {}), ("b", "y", None, {})]))
    h = {r.key: r.source_hash for r in src.collect()}
    locales = spark.createDataFrame([(0, "en", True), (0, "de", False), (0, "es", False), (1, "de", False)], "project int, locale string, is_source boolean")
    ent = durable(spark.createDataFrame(
        [(0, "de", "a", "A", False, h["a"]), (0, "es", "a", " ", True, h["a"]), (0, "ja", "a", "J", False, "x"), (0, "de", "b", "B", True, "old"),
         (0, "de", "gone", "G", False, "x"), (0, "es", "b", "B", False, "old"), (0, "es", "b", "B2", True, h["b"]), (1, "de", "a", "A", False, "x")],
        "project int, locale string, key string, text string, reviewed boolean, source_hash string"))
    pairs = planning.classify_pairs(src, ent, locales)
    assert sorted((r.locale, r.key, r.reason) for r in pairs.collect()) == [
        ("de", "a", "current"), ("de", "b", "reviewed_stale"), ("es", "a", "missing"), ("es", "b", "current"), ("es", "b", "stale")]
    dealt = [x for x in pairs._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if re.search(r"hashpartitioning\([^)]*locale#[^)]*key#", x)]
