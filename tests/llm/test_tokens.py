"""Tokens: the encoders against the library, packing invariants, addressable files."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexilake.llm import bpe, packing, token_files
from lexilake.llm.tokens import ByteEncoder, WordEncoder, as_bytes

ODD = [
    "", " ", "a  b", " x", "x ", "\n\nfoo", "it's İstanbul ΣΑΣ ½ x² 12 a_b", "<|endoftext|>b c <|startoftext|> d",
    "<|ENDOFTEXT|> A", "a\tb \t c", "café é", "\u3000wide\u00a0sp", "日本語 テキスト", "don't I'LL we'Re", "🙂🙂 ok",
    "\x1c a\x1cb", "가 ᄒ", "a" * 3000, "The End.</w> x</w>", "\0 nul a", "foo\r\nbar", "ß ẞ ﬁ ŉ ǰ", "x̧́y ́z", "Of%%% the&&& a.b,c (d) [INST]",
    "Word " * 500]


@pytest.mark.parametrize("name,kind", [
    ("word_bpe_49k", WordEncoder), ("word_bpe_49k", bpe.MergeEncoder), ("byte_bpe_50k", ByteEncoder)])
def test_ids_are_the_library_s(name, kind):
    library, own = Tokenizer.from_file(path(f"{name}.json")), kind(path(f"{name}.json"))
    texts = ODD + [a + b for a in ODD[:20] for b in ODD[3:23:4]]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert as_bytes(want) == ids, text
        if kind is bpe.MergeEncoder:
            assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_a_worker_may_forget(monkeypatch):
    from lexilake.llm import tokens

    texts = [f"w{i} Other{i % 7}. the" for i in range(200)]
    for name, kind in (("word_bpe_49k", WordEncoder), ("byte_bpe_50k", ByteEncoder)):
        want = kind(path(f"{name}.json")).encode(texts)
        monkeypatch.setattr(tokens, "REMEMBERED", 20)
        assert kind(path(f"{name}.json")).encode(texts) == want
        monkeypatch.undo()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "the cat " * 3000), (3, "a  b"), (None, "null key")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("shard", F.lit("x"))


def test_packing(spark, docs):
    capacity = 64
    pieces = packing.pack_documents(docs, path("word_bpe_49k.json"), capacity=capacity, open_bins=4).toPandas()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = sorted((repr(r["doc_id"]), as_bytes([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    got = {}
    for r in pieces.sort_values("piece").itertuples():
        got.setdefault((r.doc_id, r.start - r.piece * capacity), []).append(bytes(r.ids))
        assert r.start == r.piece * capacity and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    whole = sorted(b for _, b in want)
    # Document 3 comes twice with the same text, so its pieces come twice.
    assert sum(map(len, whole)) == sum(len(x) for v in got.values() for x in v)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= capacity
        assert list(g.offset) == list(g.length.cumsum() - g.length)


def test_best_fit_is_the_fullest_that_fits():
    fit, free, random = packing.BestFit(100, 5), {}, np.random.default_rng(1)
    for length in random.integers(1, 101, 2000).tolist():
        number, offset = fit.place(length)
        options = [f for f in free.values() if f >= length]
        if options:
            assert free[number] == min(options)
        else:
            assert number not in free and offset == 0
            if len(free) >= 5 and length < 100:
                del free[min(free, key=free.get)]
        free[number] = 100 - offset - length
        if not free[number]:
            del free[number]
        # Which of several equally full sequences closed does not matter: amounts of free space do.
        assert sorted(free.values()) == sorted(f for f, b in enumerate(fit.bins) for _ in b)
        free = dict(zip([n for b in fit.bins for n in b], [f for f, b in enumerate(fit.bins) for _ in b]))


def test_shards_give_any_token():
    random = np.random.default_rng(2)
    for ids in ([], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], random.integers(0, 300, 3000), random.integers(0, 70000, 5000)):
        ids = np.asarray(ids, dtype=np.uint32)
        starts = np.unique(np.concatenate([[0], np.sort(random.integers(0, len(ids) + 1, 5)), [len(ids)]]))
        shard = token_files.Shard(token_files.encode_shard(ids, starts))
        assert (shard.read(0, len(ids)) == ids).all()
        for i in random.integers(0, len(ids), 50) if len(ids) else []:
            assert shard[int(i)] == ids[i]
            j = int(random.integers(i, len(ids) + 1))
            assert (shard.read(int(i), j) == ids[i:j]).all()
        for k in range(shard.documents):
            assert (shard.document(k) == ids[starts[k]:starts[k + 1]]).all()


def test_token_files(spark, docs, tmp_path):
    for n, rows in (("all", docs), ("none", docs.limit(0))):
        where = str(tmp_path / n)
        token_files.write_token_files(rows, where, path("byte_bpe_50k.json"), partitions=3, shard_tokens=2000)
        got = token_files.documents_of(token_files.read_token_files(spark, where)).orderBy("start").toPandas()
        library = Tokenizer.from_file(path("byte_bpe_50k.json"))
        data = sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
        start = 0
        assert len(got) == len(data)
        for r, g in zip(data, got.itertuples()):
            want = as_bytes([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])
            assert (g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (start, len(want) // 4, zlib.crc32(want), want)
            start += len(want) // 4


def test_round_trip_digests(spark, docs):
    import hashlib

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.round_trip_digests(docs, path("word_bpe_49k.json")).collect()}
    decoded = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(docs, path("word_bpe_49k.json")), path("word_bpe_49k.json")).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        row = got[r["doc_id"], hashlib.sha256(as_bytes(ids)).hexdigest()]
        assert row["n_tokens"] == len(ids) and row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["doc_id"], text) in decoded
