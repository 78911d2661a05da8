"""Byte-pair encoding and decoding of whole texts.

Encoding: a text is normalized and cut into pieces; a piece is a doubly linked list of symbols; a heap
holds the merges its neighbours allow, lowest rank first, then leftmost; popping one joins its two symbols
if both are still what they were when it was pushed, else the entry is stale and skipped.  Decoding
looks ids up in the vocabulary and concatenates the strings.  Both are narrow steps without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexilake.llm.shared import map_rows
from lexilake.llm.tokens import Encoder, as_bytes, encoder, lower_case, plain_parts


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class MergeEncoder(Encoder):
    """The vocabulary of a tokenizer file with lower-case words and word-end marks."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = vocab
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[str] = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a in vocab and b in vocab and a + b in vocab:
                self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.symbols = byte_symbols()
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])

    def split(self, text: str) -> list[str]:
        return lower_case(text).replace("\n", " ").split(" ")

    def parts(self, chunk: str) -> list[str] | None:
        return plain_parts(chunk.lower())

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        return [as_bytes(self.merge(p)) for p in parts]

    def whole(self, text: str) -> bytes:
        ids: list[int] = []
        at = 0
        for m in self.at_special.finditer(text):
            ids += self._ordinary(text[at:m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return as_bytes(ids + self._ordinary(text[at:]))

    def _ordinary(self, text: str) -> list[int]:
        # Each character is lower-cased by itself, so a final sigma has no form of its own.
        lowered = "".join(c.lower() for c in regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)))
        return [i for piece in self.pieces.findall(lowered) for i in self.merge(piece)]

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        merges, vocab = self.merges, self.vocab
        marks = [self.symbols[b] for b in piece.encode()]
        marks[-1] += self.end
        ids = [vocab[m] for m in marks if m in vocab]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = joined, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if found := merges.get((joined, ids[k])):
                    heapq.heappush(heap, (found[0], i, joined, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], joined))):
                heapq.heappush(heap, (found[0], h, ids[h], joined, found[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings, in order, with a space between: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): little-endian unsigned 32-bit ids; null and empty texts have none; repeated rows stay."""
    def make():
        bpe = encoder(MergeEncoder, tokenizer_path)
        return lambda b: {key: b.column(0), "ids": bpe.encode(b.column(1).to_pylist())}

    return map_rows(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary", text)


def decode(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text): null ids decode to null, no ids to the empty text."""
    def make():
        bpe = encoder(MergeEncoder, tokenizer_path)
        return lambda b: {key: b.column(0), "ids": b.column(1), "text": [
            None if ids is None else bpe.decode(ids) for ids in b.column(1).to_pylist()]}

    kind = encoded.schema[key].dataType.simpleString()
    return map_rows(encoded.select(key, "ids"), make, f"{key} {kind}, ids binary, text string", "ids")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping digests only."""
    def make():
        bpe = encoder(MergeEncoder, tokenizer_path)

        def digest(b: pa.RecordBatch) -> dict:
            ids = bpe.encode(b.column(1).to_pylist())
            return {key: b.column(0), "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]}

        return digest

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make,
                    f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text)
