"""The pipeline's stages, each against its operator or brute force on what it was given."""

from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from lexilake.llm import quality, toxicity
from lexilake.session import durable
from test_minhash import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "toxicity", "minhash_near_duplicates", "best_fit_packing"]
    given = docs
    for (name, stage), module in zip(corpus_pipeline.STAGES[:2], (quality, toxicity)):
        kept = durable(stage(spark, given, sf))
        assert kept.columns == docs.columns and kept.schema == given.schema
        model = module.train(docs, labels)
        scores = {r["doc_id"]: r["score"] for r in module.score_documents(given, model).collect()}
        want = {i for i, s in scores.items() if (s >= 0.3 if module is quality else s < 0.3)}
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want and 0 < len(want) < given.count()
        given = kept
    kept = durable(corpus_pipeline.STAGES[2][1](spark, given, sf))
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    want = {i for i, (_, root, _) in brute(rows, 5, 80).items() if root == i}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
    packed = corpus_pipeline.STAGES[3][1](spark, kept, sf).toPandas()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    lengths = packed.groupby("doc_id").length.sum().to_dict()
    assert lengths == {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    total = corpus_pipeline.run(spark, sf)
    assert sorted(total.columns) == sorted(packed.columns) and total.count() == len(packed)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_odd_rows(spark):
    """Null and repeated ids, null, blank and very long texts, no rows at all."""
    sf = "/root/testdata/sf0.001"
    near = dict(corpus_pipeline.STAGES)["minhash_near_duplicates"]
    body = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, body, "en", "a", 1), (1, body, "en", "a", 1), (1, other, "en", "a", 1), (2, body + " end", None, None, None), (None, body, "en", "a", 1),
            (None, other + " end", "en", "a", 1), (None, "alone here in this place of texts", "en", "a", 1), (3, None, "en", "a", 1), (3, " ", "en", "a", 1),
            (4, "long " * 200_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5], len(r.text or "")) for r in kept.collect()) == sorted(
        (i or 0, (t or "")[:5], len(t or "")) for i, t in [(1, body), (1, other), (None, "alone here in this place of texts"), (3, None), (3, " "), (4, "long " * 200_000)])
    empty, odd = docs.limit(0), docs
    for _, stage in corpus_pipeline.STAGES:
        empty, odd = durable(stage(spark, empty, sf)), durable(stage(spark, odd, sf))
    assert empty.count() == 0 and odd.columns == empty.columns
