"""Quality and toxicity: parts against brute force, wholes on held-out documents."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexilake.llm import quality, toxicity
from lexilake.llm.queries import QUERIES


def test_segments_are_maximal():
    random = np.random.default_rng(0)
    for _ in range(300):
        x = np.round(random.normal(-0.3, 1, random.integers(0, 14)), 2)

        def recurse(a, b):
            best = max(((round(x[i:j].sum(), 9), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            return recurse(a, best[2]) + [(best[2], best[3])] + recurse(best[3], b)

        found = toxicity.segments(x)
        assert [round(x[s:e].sum(), 6) for _, s, e in found] == [round(v, 6) for v, _, _ in found]
        assert sorted(round(x[s:e].sum(), 6) for s, e in recurse(0, len(x))) == sorted(round(v, 6) for v, _, _ in found)


def test_marginals_are_those_of_all_labellings():
    random = np.random.default_rng(1)
    at = np.array([0, 3, 4, 9])
    odds, pair = random.normal(size=9), random.normal(size=(2, 2))
    got, _, logz = quality.Chains(at).marginals(odds, pair)
    total = 0.0
    for a, b in zip(at, at[1:]):
        weight, good = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum((l - 0.5) * odds[a + i] for i, l in enumerate(labels)) + sum(pair[p, q] for p, q in zip(labels, labels[1:])))
            weight += w
            good += w * np.array(labels)
        assert np.allclose(got[a:b], good / weight)
        total += np.log(weight)
    assert np.isclose(logz, total)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["", None, "a", "one line.\n\nThree x x x\n", "\n", "ä | b | c", "end", "w " * 9000]
    together, length, at = quality.line_features(pa.array(texts))
    assert list(np.diff(at)) == [(t or "").count("\n") + 1 for t in texts]
    assert [length[a:b].tolist() for a, b in zip(at, at[1:])] == [[len(x.encode()) for x in (t or "").split("\n")] for t in texts]
    for i, t in enumerate(texts):
        alone, _, _ = quality.line_features(pa.array([t], pa.string()))
        assert np.allclose(alone, together[at[i]:at[i + 1]])


@pytest.mark.parametrize("name,label", [("op1_quality_classifier", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_documents(spark, name, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    y, s = rows[label].to_numpy(), rows["score"].rank().to_numpy()
    area = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert len(rows) > 500 and area > 0.93
    assert (rows["predicted"] == y).mean() > 0.94


def test_odd_rows_score(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "\n\n"), (3, "\n\n"), (4, "idiot " * 40000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    for module, rows in ((quality, labels), (toxicity, labels)):
        for given in (rows, rows.limit(0)):
            model = module.train(docs, given)
            got = module.score_documents(odd, model).collect()
            assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
            assert module.score_documents(odd.limit(0), model).count() == 0
            kept = module.keep_documents(odd, model, 0.3)
            assert kept.columns == odd.columns
