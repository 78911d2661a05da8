"""Closed syncmers against a brute-force version in plain Python."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lexilake.llm import syncmers
from lexilake.llm.queries import QUERIES

SEED = 42


def of_bytes(data, seed=SEED):
    return xxhash.xxh64_intdigest(data, seed)


def of_longs(values):
    h = SEED
    for v in values:
        h = of_bytes(struct.pack("<Q", v), h)
    return h


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def anchors(text):
    """A dictionary hash -> place for each level, None where the level does not serve."""
    h = [of_bytes(u.encode()) for u in re.findall(r"[^\x20\x09-\x0D]{1,8}", text)]
    out = []
    for k, s, low, high in syncmers.LEVELS:
        if len(h) < low or high is not None and len(h) >= high:
            out.append(None)
            continue
        inner = [signed(h[i]) if s == 1 else signed(of_longs(h[i:i + s])) for i in range(len(h) - s + 1)]
        found = {}
        for i in range(len(h) - k + 1):
            window = inner[i:i + k - s + 1]
            if min(window) in (window[0], window[-1]):
                found.setdefault(of_longs(h[i:i + k]) & 0x7FFFFFFF, i)
        if k > 1 and len(h) < k:
            found = {of_longs(h) & 0x7FFFFFFF: 0}
        out.append(found)
    return out


def as_text(levels):
    def entry(h, i):
        return f"{h << 33 | i:x}"

    return "/".join("-" if v is None else " ".join(entry(h, i) for h, i in sorted(
        v.items(), key=lambda x: signed(x[0] << 33 | x[1]))) for v in levels)


def likeness(a, b):
    if all(x is None for x in a) and all(x is None for x in b):
        return 1.0
    best = 0.0
    for x, y in zip(a, b):
        if x is None or y is None:
            continue
        shared = sorted((i, y[h] - i) for h, i in x.items() if h in y)
        n = sum(m == 0 or (j > 0 and shared[j - 1][1] == m) or (j + 1 < len(shared) and shared[j + 1][1] == m)
                for j, (_, m) in enumerate(shared))
        best = max(best, n / max(len(x), len(y), 1))
    return best


def brute(rows):
    """Rows (id, text) in falling order of id, each with its edit and the next."""
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        t = len(text) // 3
        edited = text[:len(text) - t] + after[:t]
        a, b, c = anchors(text), anchors(edited), anchors(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    return out


LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
TEXTS = ["", " \n\t ", "one", "one two", "That it is.", "é🙂 ñandú " * 9, "ab" * 500, "a " * 300, LONG, LONG[:9000] + "x", "🙂" * 40,
         "x y z " * 8, " ".join(f"t{i}" for i in range(127)), " ".join(f"t{i}" for i in range(60)), "same same", "same same"]


def got(df):
    return [tuple(r) for r in df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]


def test_equals_brute_force(spark):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(k, t or None, "k", 1) for k, t in rows[::-1]], "doc_id long, text string, row_key string, copies int")
    made = sorted(got(syncmers.edit_likeness(docs.repartition(5))))
    want = sorted(brute(rows))
    assert [r[:5] for r in made] == [r[:5] for r in want]
    assert [r[5:] for r in made] == [pytest.approx(r[5:]) for r in want]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    df = QUERIES["op12_fingerprints"](spark, folder)
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    made, want = sorted(tuple(r) for r in df.collect()), sorted(brute(rows))
    assert [r[:5] for r in made] == [r[:5] for r in want]
    assert [r[5:] for r in made] == [pytest.approx(r[5:]) for r in want]


def test_repeated_rows_null_keys_and_small_tables(spark):
    schema = "doc_id long, text string"
    assert syncmers.edit_likeness(spark.createDataFrame([], schema)).count() == 0
    alone = got(syncmers.edit_likeness(spark.createDataFrame([(1, "a b c")], schema)))
    assert alone[0][:2] == (1, 5) and alone[0][6] == 1.0
    rows = [(7, "p q r s"), (7, "p q r s"), (7, "p q r s"), (3, "u v w"), (None, "last of all"), (None, None)]
    made = syncmers.edit_likeness(spark.createDataFrame(rows, schema)).select("doc_id", "next_doc_id", "near_next", "n_chars").collect()
    assert len(made) == 6
    sevens = sorted((r.next_doc_id, r.near_next) for r in made if r.doc_id == 7)
    assert sevens == [(3, 0.0), (7, 1.0), (7, 1.0)]
    assert [r.next_doc_id for r in made if r.doc_id == 3] == [None]
    assert sorted(r.next_doc_id or 0 for r in made if r.doc_id is None) == [0, 7]
