"""Documents cut into members, against parsers that read them whole; logs by line; parts and their manifest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexilake.sources import catalogs, history, members, xcstrings
from lexilake.sources.documents import is_object, strict_json
import rows as t


def text_of(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.4:
        return json.dumps(r.choice(["", "a,b", '{"x": [', '\\"}', "é🙂", "end\\", None, True, 7, -1.5, "]},", '"']), ensure_ascii=r.random() < 0.5)
    gap = lambda: r.choice(["", "", " ", "\n  ", "\t\r\n"])
    inner = [text_of(r, depth + 1) for _ in range(r.randint(0, 4))]
    if kind < 0.6:
        return "[" + gap() + ",".join(gap() + x + gap() for x in inner) + "]"
    names = [json.dumps(r.choice(["k", "a", "{", "b,c", '\\"'])) for _ in inner]
    return "{" + gap() + ",".join(f"{gap()}{n}{gap()}:{gap()}{x}{gap()}" for n, x in zip(names, inner)) + "}"


def documents(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = "{" + ",".join(f'"{name}":{text_of(r)}' for name in r.sample(["a", "b", "c", "d"], r.randint(0, 4))) + "}" + r.choice(["", "\n"])
        if r.random() < 0.6:
            for _ in range(r.randint(1, 2)):
                at = r.randrange(len(text) + 1)
                text = text[:at] + r.choice(["", ",", "{", "}", "[", "]", '"', ":", "\\", " ", "x"]) + text[at + r.randint(0, 1):]
        out.append(text)
    return out + ["", " ", "[]", "[1,2]", "7", '"a,b"', "{}", "{} {}", "{},{}", "{}}", '{"a":1,}', '{,"a":1}', '{"a":1,,"b":2}', '{"a":{,"b":1}}',
                  '{"a":{"b":1,}}', '{"a":[1,]}', '{"a":[,1]}', '{"a":[1}', '{"a":{"b":1],"c":2}', '{"a":1', '{"a":"', '{"a":"\\', '{"a":"x\\,y"}', '{"a":[1,2}]']


def test_documents_are_well_formed_where_a_whole_parse_says_so(spark):
    docs = t.texts(spark, *documents(1, 1500))
    blocks = members.blocks_of(docs).withColumn("block", F.floor(F.col("at") / 3)).repartition(5)
    cut = members.of_documents(members.members(blocks)).select("path", "good")
    v = strict_json(F.col("text"))
    whole = docs.select("path", "text", F.coalesce(v.isNotNull() & is_object(v), F.lit(False)).alias("want"))
    rows = whole.join(cut, "path", "left").collect()
    assert [(r.text, r.want, r.good) for r in rows if r.want != r.good] == []
    assert 300 < sum(r.want for r in rows) < len(rows) - 300


def test_members_are_those_of_the_document(spark):
    texts = [x for x in documents(2, 400) if _object(x)]
    docs = t.texts(spark, *texts)
    rows = members.members(members.blocks_of(docs).withColumn("block", F.floor(F.col("at") / 2)))
    last = members.of_documents(rows, a=F.lit(True))
    found = {(r.path, r.key): json.loads(r.item) for r in members.keyed(rows, last, "a", F.to_json("_v")).collect()}
    want = {(str(i), k): v for i, x in enumerate(texts) if isinstance(json.loads(x).get("a"), dict) for k, v in json.loads(x)["a"].items()}
    assert found == want and want


def _object(text):
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def source_document(n, indent):
    keys = {f"k{i:05}": {"text": f'text, {{n}} "{i}"', "description": "d}", "placeholders": {"n": {"type": "number", "example": "1,2"}}} for i in range(n)}
    return json.dumps({"keys": keys, "version": 1}, indent=indent)


@pytest.fixture
def small_blocks(spark):
    """Files are read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_span_tasks(spark, tmp_path, small_blocks):
    for name, text in {"1/one.json": source_document(400, None), "2/two.json": source_document(300, 2) + "\n", "3/empty.json": "",
                       "4/blank.json": "\n", "5/cut.json": source_document(50, 2)[:-1], "6/more.json": source_document(5, 2) + ",",
                       "7/bad.json": source_document(9, None).replace('"text, {n} \\"7\\""', '""'), "8/old.json": '{"version": 2, "keys": {}}'}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows, bad = catalogs.read_source_catalogs(spark, str(tmp_path), project_pattern=r"/(\d)/[a-z]*\.json")
    assert {(r.project, r["count"]) for r in rows.groupBy("project").count().collect()} == {(1, 400), (2, 300)}
    assert rows.filter("text = 'text, {n} \"7\"' AND placeholders['n'].example = '1,2'").count() == 2
    assert sorted((r.project, r.code) for r in bad.collect()) == [(p, "L10N_E0010") for p in (3, 4, 5, 6, 7, 8)]


def test_a_document_longer_than_any_parser_takes(spark, tmp_path):
    """One line of 200 MB, beyond the 128 MB that a variant may have."""
    n, filler = 40_000, "x" * 5000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"version":1,"keys":{')
        for i in range(n):
            f.write(("," if i else "") + f'"k{i}":{{"text":"{filler},{i}"}}')
        f.write("}}")
    rows, bad = catalogs.read_source_catalogs(spark, str(tmp_path))
    got = rows.agg(F.count_distinct("key").alias("n"), F.sum(F.length("text")).alias("s")).first()
    assert (got.n, got.s) == (n, sum(5001 + len(str(i)) for i in range(n))) and bad.count() == 0


def test_other_documents_by_members(spark, tmp_path):
    h = "sha256:" + "0" * 64
    entry = {"source_hash": h, "locale": "de", "config_hash": h, "model_version": "m,1", "text": "a,b", "cached_at": "2024-01-01T00:00:00.000Z"}
    caches = {"a": {"version": 3, "entries": [entry, entry]}, "b": {"version": 2}, "c": {"version": 3, "entries": [entry, {**entry, "locale": "x-"}]},
              "d": {"version": 3, "entries": {}}, "e": {"entries": []}, "f": {"version": 3, "entries": []}, "g": {"version": "3", "entries": []}}
    (tmp_path / "c").mkdir()
    for name, doc in caches.items():
        (tmp_path / "c" / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "c" / "h.json").write_text('{"version": 1')
    rows, found = catalogs.read_cache(spark, str(tmp_path / "c"))
    assert [(r.text, r.model_version) for r in rows.collect()] == [("a,b", "m,1")] * 2
    assert sorted((r.path[-6:-5], r.code[-2:]) for r in found.collect()) == [("b", "86"), ("c", "60"), ("d", "60"), ("e", "60"), ("g", "60"), ("h", "60")]
    (tmp_path / "s").mkdir()
    for name, doc in {"one": {"version": 1, "files": {"a,b": "x,{", "c": None}}, "two": {"version": 1, "files": {"a": 1}}, "three": {"version": 1}}.items():
        (tmp_path / "s" / f"{name}.json").write_text(json.dumps(doc, indent=1))
    rows, bad = history.read_snapshots(spark, str(tmp_path / "s"))
    assert sorted((r.history_id, r.path, r.content) for r in rows.collect()) == [("one", "a,b", "x,{"), ("one", "c", None)]
    assert bad.count() == 2
    unit = {"stringUnit": {"state": "translated", "value": "Hi, %1$@"}, "substitutions": {"n": {"argNum": 1, "formatSpecifier": "@"}}}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "L.xcstrings").write_text(json.dumps({
        "sourceLanguage": "en", "strings": {"a": {"comment": "c", "localizations": {"en": unit}}, "b": {}}, "version": "1.0"}))
    rows, bad = xcstrings.ingest_xcstrings(spark, str(tmp_path / "x"))
    assert [(r.key, r.locale, r.text, r.comment) for r in rows.collect()] == [("a", "en", "Hi, {n}", "c")] and bad.count() == 0


def test_lines_are_numbered_across_blocks(spark, tmp_path, small_blocks):
    row = '{"id": "%d", "op": "sync", "actor": "a", "ts": "2024-01-01T00:00:00.000Z", "summary": "' + "s" * 40 + '"}\n'
    (tmp_path / "fine.jsonl").write_text("".join(row % i for i in range(500)) + '{"id": "cut')
    (tmp_path / "torn.jsonl").write_text("".join(row % i for i in range(300)) + "{}\n" + row % 1 + "\n\n")
    (tmp_path / "none.jsonl").write_text("")
    lines = history.file_lines(spark, str(tmp_path))
    assert lines.select("path", F.floor(F.col("line_no") / 1000)).distinct().count() == 2
    rows, found = history.read_history(spark, str(tmp_path))
    assert {(r.line_no, r.id) for r in rows.collect()} == {(i + 1, str(i)) for i in range(500)}
    assert sorted((r.path.split("/")[-1], r.code, r.details["line"]) for r in found.collect()) == [
        ("fine.jsonl", "L10N_E0078", "501"), ("torn.jsonl", "L10N_E0062", "301")]
    text = (tmp_path / "torn.jsonl").read_text().split("\n")
    got = {r.line_no: r.line for r in lines.filter(F.col("path").endswith("torn.jsonl")).collect()}
    assert got == {i: line for i, line in enumerate(text[:-1], 1)}


def test_text_of_files_is_not_dealt_out(spark, tmp_path, small_blocks, monkeypatch):
    """Members come from scans in order; only what spans blocks is gathered.  Arrow batches end anywhere."""
    def dealt(pieces):
        raise AssertionError("the text of files was shuffled")

    monkeypatch.setattr(members, "_in_order", dealt)
    r = random.Random(4)
    keys = {f"k,{i}": {"text": r.choice(['a,b "{', "x" * 300, "[,]", "\\"]), "description": ",".join("d" * r.randint(0, 9)) or None} for i in range(300)}
    (tmp_path / "one.json").write_text(json.dumps({"o,{": {"a": [1, 2]}, "keys": keys, "version": 1, "z": [1, {"a": [2, 3]}]}))
    want = {k: v["text"] for k, v in keys.items()}
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            rows = members.read_members(spark, str(tmp_path))
            last = members.of_documents(rows, keys=F.lit(True))
            found = {x.key: json.loads(x.item)["text"] for x in members.keyed(rows, last, "keys", F.to_json("_v")).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert found == want and last.first().good
