"""URL filter: prefix rules and a list of URLs, behind a blocked Bloom filter.

A rule is (host, path, verdict): it fits its host and all subdomains of it, where the URL's path starts with
the rule's path.  A listed URL fits only its canonical form: host and path.  Both are keys of one list.  A page
has a key for each suffix of its host and each path length that rules use, and one for its whole URL.  Keys
of pages pass a blocked Bloom filter, one 512-bit block for each key, before they meet the list in an
exact hash join, which removes false positives; of the rules that fit, the longest host and path wins.

The filter is built in one aggregation over blocks and sent to tasks only while it is below a byte bound.
A list too long for that bound meets pages in the join alone: same rows, more shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.llm.shared import pa_schema
from lexilake.session import ship_package

BLOCK_BITS = 512
PROBES = 8
KEYS_A_BLOCK = 32
FILTER_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and bits inside a block for each key: the key's low bits step through the block."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(9)) | np.uint64(1)
    bits = (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BLOCK_BITS)
    return (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))


def build_filter(keys: DataFrame) -> tuple[np.ndarray | None, int]:
    """The filter's blocks as rows of 8 words, and their number; None if it would be over the byte bound.

    Sized by the list: the count of keys is taken first.  Bits are set block by block in tasks.
    """
    count = keys.count()
    blocks = max(1, -(-count // KEYS_A_BLOCK))
    if blocks * BLOCK_BITS // 8 > FILTER_BYTES:
        return None, blocks
    ship_package(keys.sparkSession)
    ddl = "block long, word long, bits long"
    out = pa_schema(keys.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            word, bit = _probes(h)
            block = np.repeat((h >> 20) % blocks, PROBES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(word.ravel()), pa.array(bit.ravel().view(np.int64))], schema=out)

    rows = keys.select("key").mapInArrow(run, ddl).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros((blocks, BLOCK_BITS // 64), dtype=np.uint64)
    for batch in rows.toArrow().to_batches():
        block, word, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        table[block.astype(np.int64), word.astype(np.int64)] = bits.astype(np.int64).view(np.uint64)
    return table, blocks


def maybe_listed(df: DataFrame, table: np.ndarray, key: str = "key") -> DataFrame:
    """The rows whose key may be in the filter: none that is, is lost."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(table)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in batches:
            h = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (h >> 20) % len(blocks)
            word, bit = _probes(h)
            yield batch.filter(pa.array(((blocks[block[:, None], word] & bit) != 0).all(axis=1)))

    return df.mapInArrow(run, df.schema)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, unlisted: str = "allow",
               key: str = "page_id", url: str = "url") -> DataFrame:
    """A row per page: its key, host, path, the rule that decides (or null) and the verdict.

    ``rules`` has host, path and verdict; ``listed`` has a url column of blocked URLs, canonical or not.  A
    rule decides before the list; a page that neither covers is ``unlisted``.  Pages without ``://``, or
    with a null URL, have an empty host and path, which no rule fits.  Repeated pages stay; pages that share
    a host and path are judged once.  An empty list or table of rules is no error.
    """
    judged = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    entries = rules.select(F.lit(1).alias("prefix"), "host", "path", "verdict")
    if listed is not None:
        entries = entries.unionByName(listed.select(
            F.lit(0).alias("prefix"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            F.lit("block").alias("verdict")).distinct())
    entries = entries.withColumn("key", F.xxhash64("prefix", "host", "path"))
    lengths = rules.select(F.sort_array(F.collect_set(F.char_length("path"))).alias("n")).first()["n"] or []
    sites = judged.filter(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    by_prefix = sites.select("host", "path", F.explode(suffixes).alias("h")).select(
        "host", "path", "h", F.explode(starts).alias("n")).select(
        "host", "path", F.lit(1).alias("prefix"), "h", F.expr("left(path, n)").alias("p"))
    candidates = by_prefix
    if listed is not None:
        candidates = by_prefix.unionByName(sites.select(
            "host", "path", F.lit(0).alias("prefix"), F.col("host").alias("h"), F.col("path").alias("p")))
    candidates = candidates.withColumn("key", F.xxhash64("prefix", "h", "p"))
    table, _ = build_filter(entries.select("key"))
    if table is not None:
        candidates = maybe_listed(candidates, table)
    hits = candidates.join(entries.select(
        F.col("prefix"), F.col("host").alias("h"), F.col("path").alias("p"), "verdict", "key"), ["key", "prefix", "h", "p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        "prefix", (F.char_length("h") + F.char_length("p")).alias("size"), F.char_length("h").alias("depth"),
        F.concat("h", "p").alias("rule"), "verdict")).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.when(F.col("best.prefix") == 1, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"))
