"""Canonical documents level by level against a plain recursive version, and hash trees against plain joins."""

import json
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from lexilake.operators import hash_tree
from lexilake.plans import review

NUMBERS = ["0", "-0.0", "1", "1.0", "100.50", "1e21", "123456789012345678", "1.5e-7", "0.000001", "1e2", "-2.25", "0.1"]


def js(text):
    x = float(text)
    if x == 0:
        return "0"
    if x.is_integer() and abs(x) < 1e21:
        return str(int(float(repr(x))))
    return format(Decimal(repr(x)), "f") if 1e-6 <= abs(x) < 1e21 else re.sub(r"e([+-])0*", r"e\1", repr(x))


def document(r, depth=0):
    kind = r.random()
    if depth > 3 or (depth and kind < 0.35):
        return r.choice([("number", n) for n in NUMBERS] + [("text", t) for t in ["", "a", 'q"\\', "é🙂\n"]] + [("word", w) for w in ("true", "false", "null")])
    if depth and kind < 0.6:
        return "list", [document(r, depth + 1) for _ in range(r.randint(0, 3))]
    names = r.sample(["a", "b", "c", "aa", "ab"], r.randint(0, 4))
    return "object", [(n, document(r, depth + 1)) for n in names]


def written(node, r):
    kind, value = node
    gap = r.choice(["", " ", "\n\t"])
    if kind in ("number", "word"):
        return value
    if kind == "text":
        return json.dumps(value, ensure_ascii=r.random() < 0.5)
    if kind == "list":
        return "[" + gap + ",".join(gap + written(x, r) for x in value) + gap + "]"
    return "{" + gap + ",".join(f'{gap}"{n}"{gap}:{written(x, r)}' for n, x in value) + gap + "}"


def canonical(node, pad=""):
    kind, value = node
    if kind == "number":
        return js(value)
    if kind == "word":
        return value
    if kind == "text":
        return json.dumps(value, ensure_ascii=False)
    inner = pad + "  "
    if kind == "list":
        lines = [inner + canonical(x, inner) for x in value]
        return "[\n" + ",\n".join(lines) + "\n" + pad + "]" if lines else "[]"
    lines = [f'{inner}"{n}": {canonical(x, inner)}' for n, x in sorted(value)]
    return "{\n" + ",\n".join(lines) + "\n" + pad + "}" if lines else "{}"


def test_documents_become_canonical_and_stay_so(spark):
    r = random.Random(4)
    nodes = [document(r) for _ in range(150)] + [("object", []), ("object", [("a", ("list", [("list", [("object", [("b", ("number", "1.0"))])])]))])]
    rows = [(i % 3, f"f{i}", written(n, r)) for i, n in enumerate(nodes)] + [(0, "bad", '{"a": 1')]
    files = spark.createDataFrame(rows, "project int, path string, text string")
    texts, found, summary = review.repair_documents(files)
    want = {f"f{i}": canonical(n) + "\n" for i, n in enumerate(nodes)}
    got = {x.path: x.text for x in texts.collect()}
    assert got == {p: text for (_, p, was), text in zip(rows, [want.get(x[1]) for x in rows]) if text is not None and text != was}
    assert [x.path for x in found.collect()] == ["bad"]
    assert sum(x.reformatted for x in summary.collect()) == len(got)
    again, _, summary = review.repair_documents(spark.createDataFrame([(0, p, x) for p, x in want.items()], files.schema))
    assert again.count() == 0 and sum(x.reformatted for x in summary.collect()) == 0


def test_hash_trees_find_what_differs(spark):
    r = random.Random(6)
    before = {(p, f"k{i}"): f"h{i}" for p in (0, 1) for i in range(900)}
    after = dict(before)
    for key in r.sample(sorted(before), 25):
        after[key] = "x"
    for key in r.sample(sorted(before), 10):
        after.pop(key, None)
    after[1, "new"] = "n"
    frame = lambda rows: spark.createDataFrame([(p, k, h) for (p, k), h in rows.items()], "project int, key string, source_hash string")
    got = {(x.project, x.key): x.change for x in hash_tree.changed_keys(frame(before), frame(after), depth=2).collect()}
    want = {k: "added" if k not in before else "removed" if k not in after else "changed"
            for k in {*before, *after} if before.get(k) != after.get(k)}
    assert got == want
    trees = [hash_tree.hash_tree(frame(x).repartition(n), 2) for x, n in ((before, 3), (before, 7), (after, 3))]
    roots = [{tuple(x) for x in tree.filter("level = 0").select("project", "digest", "n").collect()} for tree in trees]
    assert roots[0] == roots[1] != roots[2] and {n for *_, n in roots[0]} == {900}
    assert hash_tree.changed_keys(frame(before), frame(before)).count() == 0
    assert hash_tree.tree_depth(10 ** 9) == 6 and F is not None
