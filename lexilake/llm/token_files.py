"""Token ids as directly addressable codes: any token can be read without decoding a block.

A shard holds the ids of consecutive documents.  Each id is cut into chunks of 8 bits, lowest first.  Level 0
has a byte per id, and a bitmap with a bit per byte that says whether the id goes on in the next level; level
1 has a byte for each id that goes on, and so forth.  A rank directory holds, for every 512 bits of a bitmap,
the number of ones before them, so the place of an id in the next level is one directory entry and the ones
of at most 512 bits.  Document boundaries are an array of starts.

Bytes of a shard, all little-endian: magic ``DAC1``; number of levels (u32), of ids (u64), of documents (u64);
for each level its number of chunks (u64); document starts (u64 each, with the end); then for each level its
chunks, and for each but the last its bitmap (padded to 8 bytes) and its rank directory (u64 each).

``write_token_files`` stores shards as rows of a Parquet table (shard number, ids its task wrote before, keys,
number of ids, payload): Spark's committer makes the write safe against lost and repeated tasks on any file system.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.shared import pa_schema, slices
from lexilake.llm.tokens import ByteEncoder, encoder
from lexilake.session import durable, ship_package

MAGIC = b"DAC1"
RANK_BITS = 512
SHARD_TOKENS = 2_000_000
#: Shard order is task number x 2^32 + number in the task.
TASK_SHIFT = 32


def encode_shard(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The bytes of a shard; ``starts`` has the first position of each document and the end."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, more = (rest & 0xFF).astype(np.uint8), rest >> 8
        on = more > 0
        if not on.any():
            levels.append((chunk, None))
            break
        levels.append((chunk, on))
        rest = more[on]
    parts = [MAGIC, np.uint32(len(levels)).tobytes(), np.array([len(ids), len(starts) - 1], "<u8").tobytes(),
             np.array([len(c) for c, _ in levels], "<u8").tobytes(), starts.astype("<u8").tobytes()]
    for chunk, on in levels:
        parts.append(chunk.tobytes())
        if on is not None:
            bits = np.packbits(on, bitorder="little")
            ones = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64)
            parts += [bits.tobytes(), bytes(-len(bits) % 8), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(parts)


class Shard:
    """Read access to the bytes of a shard."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        count = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.size, self.documents = (int(x) for x in np.frombuffer(data, "<u8", 2, 8))
        sizes = np.frombuffer(data, "<u8", count, 24).astype(np.int64)
        at = 24 + 8 * count
        self.starts = np.frombuffer(data, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.levels = []
        for k, n in enumerate(map(int, sizes)):
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k < count - 1:
                width = -(-n // 8)
                bits = np.frombuffer(data, np.uint8, width, at)
                at += width + -width % 8
                ranks = np.frombuffer(data, "<u8", -(-n // RANK_BITS), at)
                at += ranks.nbytes
            self.levels.append((chunk, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """One id, by rank alone."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            before = np.unpackbits(bits[block * RANK_BITS // 8:(i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(before[:i - block * RANK_BITS].sum())
            shift += 8
        return value

    def read(self, a: int, b: int) -> np.ndarray:
        """The ids from position a up to b: what goes on from a range is a range of the next level."""
        out = np.zeros(max(0, b - a), dtype=np.uint32)
        place, lo, hi = None, a, a + len(out)
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            part = chunk[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            if place is None:
                out[:] = part
            else:
                out[place] |= part
            if bits is None or lo == hi:
                break
            block = lo // RANK_BITS
            on = np.unpackbits(bits[block * RANK_BITS // 8:-(-hi // 8)], bitorder="little")
            skip = lo - block * RANK_BITS
            goes = np.flatnonzero(on[skip:skip + hi - lo])
            lo = int(ranks[block]) + int(np.count_nonzero(on[:skip]))
            hi = lo + len(goes)
            place = goes if place is None else place[goes]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None,
                      shard_tokens: int = SHARD_TOKENS, text: str = "text", key: str = "doc_id") -> None:
    """Encode all texts, each with ``end_id`` after it, and write them in ascending key order as shards.

    Keys are range-partitioned, so no task sees more than its share; repeated keys stay together and are
    ordered by text; null keys come first.  Null and empty texts are their end id alone.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"shard long, before long, keys array<{kind}>, n_tokens long, payload binary"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << TASK_SHIFT
        words, end = encoder(ByteEncoder, tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        keys, parts, size, before = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(
                (number, before, list(keys), size, encode_shard(ids, starts)), out)], schema=out)

        for batch in slices(batches, text):
            for k, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                keys.append(k)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield shard()
                    keys, parts, size, number, before = [], [], 0, number + 1, before + size
        if keys:
            yield shard()

    rows = docs.select(F.col(key), F.col(text))
    order = [F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()]
    ranged = rows.repartitionByRange(partitions, order[0]) if partitions else rows.repartitionByRange(order[0])
    ranged.sortWithinPartitions(*order).mapInArrow(run, ddl).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The shards with the position of their first id: shard, keys, n_tokens, first, payload.

    Ids that other tasks wrote before come from their totals: one number for each task, broadcast.
    """
    shards = spark.read.parquet(path).withColumn("task", F.shiftright("shard", TASK_SHIFT))
    totals = shards.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect()
    position, offsets = 0, []
    for row in sorted(totals):
        offsets.append((row["task"], position))
        position += row["n"]
    base = spark.createDataFrame(offsets, "task long, base long")
    return shards.join(F.broadcast(base), "task").select(
        "shard", "keys", "n_tokens", (F.col("base") + F.col("before")).alias("first"), "payload")


def documents_of(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per document, read from the shards: key, start (ids of all documents before it), n_tokens, ids."""
    ship_package(shards.sparkSession)
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    ddl = f"{key} {kind}, start long, n_tokens long, ids binary, ids_crc32 long"
    out = pa_schema(shards.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, first, payload = (batch.column(c)[row].as_py() for c in range(3))
                shard = Shard(payload)
                whole = shard.read(0, shard.size).astype("<u4").tobytes()
                for a in range(0, len(keys), 1024):
                    at = shard.starts[a:a + 1025]
                    ids = [whole[4 * s:4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((
                        keys[a:a + 1024], (first + at[:-1]).tolist(), np.diff(at).tolist(), ids,
                        list(map(zlib.crc32, ids))), out)], schema=out)

    return shards.select("keys", "first", "payload").mapInArrow(run, ddl)
