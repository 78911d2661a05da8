"""Source divergence: skybands and ranks against brute force, and rows that are odd."""

import random
import re
from collections import Counter, defaultdict

from lexilake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, least, top):
    docs, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                 for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(words)
        langs[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = p(groups[lang, source]), p(langs[lang])
        pairs = [(s, sum(abs(own[t] - q) for t, q in p(groups[lang, s]).items())) for l, s in groups if l == lang and s != source]
        terms = [(t, own[t] - whole[t]) for t in kept if groups[lang, source][t] and own[t] > whole[t]]
        for part, items, last in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i) for i, (item, v) in enumerate(items[:last], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed, n=400):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "straße", "🙂", "Ünder", "x"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.randint(0, 40)))
        rows.append((i, r.choice([text, text.upper(), text.replace(" ", "1-_")]), r.choice(["en", "de", None]),
                     r.choice(["hot"] * 4 + ["a", "b", "ä", "", None]), "clash", 1))
    return rows + [(n, None, "fr", "lone", None, None), (n + 1, "", "it", "p", None, None), (n + 2, "rare", "it", "q", None, None)] + rows[:5]


def test_equals_brute_force(spark, monkeypatch):
    for seed, top in ((1, 3), (2, 50)):
        rows = sample(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
        assert got(divergence.audit(docs, min_documents=10, top=top)) == brute(rows, 10, top)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 40)
    monkeypatch.setattr(divergence, "CHUNK_NUMBERS", 50)
    monkeypatch.setattr(divergence, "SKYBAND_ROWS", 7)
    assert got(divergence.audit(docs, min_documents=10, top=5)) == brute(rows, 10, 5)


def test_large_counts_are_exact(spark):
    rows = [(10 ** 12 + 7, 9 * 10 ** 15, 10 ** 6), (0, 1, 1), (3, 7, 2)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    assert [r[0] for r in df.select(divergence.number(df.n, df.total, df.v)).collect()] == [
        1 + 10 ** 9 * (n + 5) // (t + 5 * v) for n, t, v in rows]


def test_skyband_keeps_what_fewer_than_k_dominate(spark):
    r = random.Random(5)
    rows = [("en", s, f"t{i:03}", r.randint(0, 9), r.randint(0, 9)) for s in "ab" for i in range(300)]
    for k in (1, 4):
        kept = {tuple(x) for x in divergence.skyband(spark.createDataFrame(
            rows, "lang string, source string, term string, n long, lang_n long").coalesce(1), k).collect()}
        want = {x for x in rows if sum(y != x and y[1] == x[1] and y[3] >= x[3] and y[4] <= x[4] and y[2] < x[2] for y in rows) < k}
        assert kept == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
