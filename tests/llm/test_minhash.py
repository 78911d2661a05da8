"""Near-duplicates against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexilake.llm import minhash


def brute(rows, words, many):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= many * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in names}


def corpus():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    for _ in range(40):
        texts.append([pick.choice(vocabulary) for _ in range(pick.randint(5, 200))])
    for base in texts[:20]:
        for _ in range(8):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 25))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            texts.append(copy)
    shared = [pick.choice(vocabulary) for _ in range(120)]
    texts += [shared + [pick.choice(vocabulary) for _ in range(60)] for _ in range(60)]
    # A chain: each step is near the next, the ends are not near.
    chain = [pick.choice(vocabulary) for _ in range(150)]
    for k in range(6):
        texts.append(chain[3 * k:3 * k + 100])
    pick.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i, " ".join(t)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "One  Two\n"), (n + 7, "É é x"), (n + 8, "É É x"),
             (n + 9, "same " * 5000), (n + 10, "same " * 400)]
    return rows


@pytest.mark.parametrize("words,many", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, words, many):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("bands", F.lit(0)).repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words, (many, 100)).collect()}
    assert got == brute(rows, words, many)


def test_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, minhash.near_duplicates(docs).collect()))
    assert len(got) == 5
    by = {(r["doc_id"]): r for r in minhash.near_duplicates(docs).collect()}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"] and by[3]["kept"] and by[None]["kept"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bands_find_pairs_at_the_threshold():
    for threshold in (0.8, 0.85):
        r = minhash.band_rows(threshold, 256)
        assert (1 - threshold ** r) ** (256 // r) <= minhash.MISSED


def hot_source(n=700, pairs=20, shared=204, own=30, seed=8):
    """Documents alike through one passage but below the threshold, some of them with one true partner."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50_000)]
    passage = [pick.choice(vocabulary) for _ in range(shared)]
    texts = [passage + [pick.choice(vocabulary) for _ in range(own)] for _ in range(n)]
    for k in range(pairs):
        copy = list(texts[n - 1 - k])
        for at in range(2, 23, 5):
            copy[shared + at] = pick.choice(vocabulary)
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words,many", [(5, 80)])
def test_pairs_hidden_in_a_hot_source(spark, words, many):
    rows = hot_source()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words, (many, 100)).collect()}
    assert got == brute(rows, words, many)


@pytest.mark.parametrize("listed,members", [(100, 200), (8, 200), (8, 16)])
def test_large_mixed_buckets_are_compared_whole(spark, monkeypatch, listed, members):
    """Even if bands separate nothing and no centre resembles a member."""
    sign = minhash.sign
    monkeypatch.setattr(minhash, "LISTED", listed)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MEMBERS", members)
    monkeypatch.setattr(minhash, "sign", lambda *a: sign(*a).withColumn("bands", F.expr("if(bands IS NULL, NULL, array(1L))")))
    rows = hot_source(60, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, (85, 100)).collect()}
    assert got == brute(rows, 3, 85)


def test_later_rounds_keep_the_bound():
    for threshold in (0.5, 0.8, 0.85):
        for signers in minhash.later_rounds(threshold, minhash.band_rows(threshold, 256)):
            bands = sum(bins // rows for bins, rows, _ in signers)
            assert (1 - threshold ** signers[0][1]) ** bands <= minhash.MISSED
            assert len({seed for _, _, seed in signers}) == len(signers)


def test_buckets_that_share_members_are_compared_once(spark):
    pick, rows = random.Random(5), []
    crowd = range(10_000, 11_500)
    for b in range(12):
        rows += [(b, i) for i in pick.sample(crowd, 900)]
    # Two large buckets with one member in common are less work apart.
    rows += [(20, i) for i in range(2000)] + [(21, i) for i in range(1999, 4000)] + [(30, i) for i in range(5000, 5009)]
    sizes = {b: sum(1 for c, _ in rows if c == b) for b, _ in rows}
    members = spark.createDataFrame([(b, i, sizes[b]) for b, i in rows], "bucket long, id long, n long")
    got = {}
    for r in minhash._together(members).collect():
        got.setdefault(r["bucket"], []).append((r["id"], r["n"]))
    assert all(len(set(m)) == len(m) == m[0][1] for m in got.values())
    groups = sorted((sorted(i for i, _ in m) for m in got.values()), key=lambda m: m[0])
    assert groups == [list(range(2000)), list(range(1999, 4000)), list(range(5000, 5009)), sorted({i for b, i in rows if b < 12})]


def test_a_group_of_like_texts_fills_few_cells(spark):
    """Texts of one pattern that are mostly no links meet in most of their buckets, but are compared once."""
    pick, rows = random.Random(9), []
    for i in range(500):
        words = [f"w{k}" for k in range(120)]
        for at in pick.sample(range(120), pick.randint(1, 3)):
            words[at] = f"x{pick.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    made, cells = [], minhash._cells
    minhash._cells = lambda members: made.append(cells(members)) or made[-1]
    keep = minhash.forget
    minhash.forget = lambda *tables: None
    try:
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()}
        assert sum(m.count() for m in made) <= 2 * len(rows)
    finally:
        minhash._cells, minhash.forget = cells, keep
    assert got == brute(rows, 3, 85)
