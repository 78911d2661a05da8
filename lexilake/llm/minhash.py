"""Near-duplicate documents by min-hashing, with every link confirmed on the full shingle sets.

1. Documents with the same set of shingles are one class; its smallest id stands for it.
2. One-permutation hashing: a set's hashes fall into bins by their top bits and the least of each bin is kept.
   Optimal densification: an empty bin takes the value of the first filled bin in an order of its own, drawn
   once, so two sets fill it alike with the probability of their similarity.
3. Bands of bins make buckets.  A bucket is a star: its hub is the member that meets the most others over all its
   buckets, which in a group of copies is the one nearest to all, and every member is a candidate of the hub alone.
   So a bucket has one candidate pair fewer than members, whatever its size.
4. Candidates are confirmed on whole sets: each member with the hub that it shares most buckets with, then, of its
   other hubs, with those that are in another component by then.  A hub's members reach it in salted shares, each with
   one copy of its text, so a large star is many small tasks.
5. Confirmed links are joined into components.  Components found before are contracted to one key each.

Only components are wanted, so a bucket within one component is settled.  In a bucket that is not, two members may be
alike though neither resembles the hub.  A small bucket's other pairs are listed, a larger one is compared in cells of
two blocks of members; buckets that share members are compared as one group where that is less.  The members of very large ones go through another round first, with fresh permutations and
bands twice as long, so that their buckets are purer, and as many bands as keep the probability of a miss.  What the
last round leaves of such buckets is compared in cells too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.components import components
from lexilake.llm.hashing import U, mix, shingle_sets
from lexilake.llm.shared import map_rows, pa_schema, slices
from lexilake.session import durable, durable_by, forget, ship_package

BINS = 256
#: A pair right at the threshold is missed by all bands of a round with at most this probability.
MISSED = 1e-5
#: Members that share a task with one copy of their centre.
STAR_SHARE = 256
#: Members of a bucket whose other pairs are listed, of a block of a larger one, and of one that goes into cells at once.
LISTED, BLOCK, MEMBERS = 8, 256, 2048
#: Rounds after the first, each with bands twice as long, and the bins of one of their permutations.
LATER_ROUNDS, LATER_BINS = 2, 1024
#: Shingles that a cell compares at a time.
COLUMNS = 8192


def band_rows(threshold: float, bins: int, missed: float = MISSED) -> int:
    """The longest bands that find a pair at ``threshold`` often enough."""
    return max(r for r in range(1, bins + 1)
               if r == 1 or (bins // r) * math.log1p(-threshold ** r) <= math.log(missed))


def band_count(threshold: float, rows: int, missed: float = MISSED) -> int:
    """The fewest bands of ``rows`` rows that find a pair at ``threshold`` often enough."""
    return math.ceil(math.log(missed) / math.log1p(-min(threshold ** rows, 1 - 1e-9)))


def later_rounds(threshold: float, rows: int) -> list[list[tuple[int, int, int]]]:
    """The signers of each round after the first: as many permutations as its bands need."""
    lengths = [min(rows << k, LATER_BINS) for k in range(1, LATER_ROUNDS + 1)]
    return [[(LATER_BINS, r, 1000 * k + p) for p in range(math.ceil(band_count(threshold, r) / (LATER_BINS // r)))]
            for k, r in enumerate(lengths, 1)]


class Signer:
    """Band hashes of sets for one round of permutations."""

    def __init__(self, bins: int, rows: int, seed: int) -> None:
        self.bins, self.rows, self.seed = bins, rows, seed
        random = np.random.default_rng(seed + 1)
        self.shift = U(64 - (bins - 1).bit_length())
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        self.order = np.stack([random.permutation(bins).astype(np.uint16) for _ in range(bins)])
        self.factors = random.integers(1, 1 << 63, rows, dtype=np.uint64) * U(2) + U(1)
        self.bands = bins // rows
        self.salts = mix(np.arange(self.bands, dtype=np.uint64) + U(1 + seed * 1_000_003))

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        values = shingles if not self.seed else np.sort(mix(shingles ^ mix(np.array([self.seed], dtype=np.uint64))))
        first = np.searchsorted(values, self.edges)
        filled = np.flatnonzero(np.diff(first, append=len(values)))
        signature = np.zeros(self.bins, dtype=np.uint64)
        signature[filled] = values[first[filled]]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            signature[empty] = signature[filled[self.order[np.ix_(empty, filled)].argmin(axis=1)]]
        rows = signature[:self.bands * self.rows].reshape(self.bands, self.rows)
        return mix((mix(rows) * self.factors).sum(axis=1, dtype=np.uint64) ^ self.salts)


def pack(docs: DataFrame) -> DataFrame:
    """(id, text) with texts compressed, each by itself: about half of what shuffles would move of them otherwise."""
    def make():
        compress = zstandard.ZstdCompressor(level=1).compress
        return lambda b: {"id": b.column(0), "text": [compress((t or "").encode()) for t in b.column(1).to_pylist()]}

    return map_rows(docs.select("id", "text"), make, "id long, text binary", "text")


def unpacked(texts: pa.Array) -> pa.Array:
    """Texts as they were; those that are not packed stay."""
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        return texts
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(t) for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string())


def sign(docs: DataFrame, words: int, signers: list[tuple[int, int, int]]) -> DataFrame:
    """(id, n_shingles, set_id, bands) of each document (id, text), packed or not; an empty set has null bands."""
    def make():
        hashers = [Signer(*signer) for signer in signers]

        def run(b: pa.RecordBatch) -> dict:
            sets = shingle_sets(unpacked(b.column(1)), words)
            return {
                "id": b.column(0), "n_shingles": [len(s) for s in sets],
                "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "bands": [np.concatenate([h.bands_of(s) for h in hashers]).view(np.int64) if len(s) else None for s in sets]}

        return run

    return map_rows(docs.select("id", "text"), make,
                    "id long, n_shingles long, set_id binary, bands array<long>", "text")


def _owned(rows: DataFrame, labels: DataFrame | None, key: str, own: str) -> DataFrame:
    """Add the component of ``key`` so far, the key itself where nothing is linked to it."""
    if labels is None:
        return rows.withColumn(own, F.col(key))
    return rows.join(labels.select(F.col("key").alias(key), F.col("component").alias("_c")), key, "left").withColumn(
        own, F.coalesce("_c", key)).drop("_c")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, id, size, n): the members of buckets that are not within one component, ``n`` in each.

    Of buckets with the same members one is taken.  The plan is the same at every size.
    """
    members = members.select("bucket", "id", "size")
    own = _owned(members, labels, "id", "own")
    kinds = own.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("all"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"),
        F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high")
    one = kinds.groupBy("n", "all", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return members.join(one.hint("merge"), "bucket")


def _stars(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(hub, id, first): each member of a bucket with its hub, once for all buckets they share, if their sizes allow a link.

    ``first`` marks the hub with which a member shares most buckets.
    """
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "id").groupBy("bucket").agg(
        F.max(F.struct("met", (-F.col("id")).alias("low"), "size")).alias("h")).select(
        "bucket", (-F.col("h.low")).alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.met").alias("hub_met"))
    stars = members.join(hubs, "bucket").filter(F.col("id") != F.col("hub")).filter(_sizes_allow("size", "hub_size", share)).groupBy(
        "hub", "id").agg(F.count(F.lit(1)).alias("buckets"), F.max("hub_met").alias("hub_met"))
    best = stars.groupBy("id").agg(F.max(F.struct("buckets", "hub_met", (-F.col("hub")).alias("low"))).alias("b")).select(
        "id", (-F.col("b.low")).alias("best"))
    return stars.join(best, "id").select("hub", "id", (F.col("hub") == F.col("best")).alias("first"))


def _sizes_allow(a: str, b: str, share: tuple[int, int]):
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def _between(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The (hub, id) pairs whose ends are in different components."""
    return _owned(_owned(pairs, labels, "id", "own"), labels, "hub", "other").filter("own != other").select("hub", "id")


def _listed(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(hub, id): all pairs of small buckets whose sizes allow a link, once."""
    whole = members.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("m"))
    pairs = whole.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, LISTED), lambda y: F.struct(
            x["id"].alias("hub"), x["size"].alias("hub_size"), y["id"].alias("id"), y["size"].alias("size")))))).alias("p"))
    return pairs.select("p.*").filter(_sizes_allow("size", "hub_size", share)).select("hub", "id").distinct()


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, component) after more links (a, b); what was one component before is one key of the new ones."""
    if labels is None:
        return components(links)
    ends = _owned(_owned(links, labels, "a", "x"), labels, "b", "y").filter("x != y")
    found = components(durable(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    moved = labels.join(found.select(F.col("key").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "key", F.coalesce("to", "component").alias("component"))
    return durable(moved.unionByName(found))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The (hub, id) pairs with 100 * shared >= percent * union of their sets; ``share`` is (percent, 100)."""
    ship_package(pairs.sparkSession)
    many, out_of = share
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR_SHARE).alias("shares"))
    salted = pairs.join(sizes, "hub").select(
        "hub", "id", F.pmod(F.xxhash64("id"), F.col("shares")).alias("salt"))
    members = salted.join(docs, "id").select("hub", "salt", F.lit(1).alias("member"), "id", "text")
    centres = salted.select("hub", "salt").distinct().join(
        docs.withColumnRenamed("id", "hub"), "hub").select("hub", "salt", F.lit(0).alias("member"), F.col("hub").alias("id"), "text")
    ddl = "a long, b long"
    out = pa_schema(pairs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, centre = None, []
        for batch in slices(batches, "text"):
            a, b = [], []
            for h, member, i, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                       batch.column(3).to_pylist(), shingle_sets(unpacked(batch.column(4)), words)):
                if not member:
                    centre = [s] if h != hub else [*centre, s]
                    hub = h
                    continue
                for c in centre:
                    shared = len(np.intersect1d(c, s, assume_unique=True))
                    if shared and out_of * shared >= many * (len(c) + len(s) - shared):
                        a.append(min(h, i))
                        b.append(max(h, i))
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return centres.unionByName(members).repartition("hub", "salt").sortWithinPartitions(
        "hub", "salt", "member").mapInArrow(run, ddl)


def linked(sets: list[np.ndarray], share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs with 100 * shared >= percent * union of their sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # A shingle of one set only is shared by no pair.
    common = counts[place] > 1
    column = (np.cumsum(counts > 1) - 1)[place[common]]
    row = row[common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        present = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        present[row[a:b], column[a:b] - low] = 1
        shared += (present @ present.T).astype(np.int64)
    many, out_of = share
    near = (shared > 0) & (out_of * shared >= many * (sizes[:, None] + sizes[None, :] - shared))
    return np.nonzero(np.triu(near, 1))


def confirm_cells(cells: DataFrame, docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(a, b) links that join all members of each cell (bucket, i, j, id) that any pairs of it join."""
    ship_package(cells.sparkSession)
    ddl = "a long, b long"
    out = pa_schema(cells.sparkSession, ddl)

    def forest(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        root = dict.fromkeys(ids)
        a, b = [], []

        def find(x: int) -> int:
            while root[x] is not None:
                x = root[x]
            return x

        for i, j in zip(*(x.tolist() for x in linked(sets, share))):
            low, high = sorted((find(ids[i]), find(ids[j])))
            if low < high:
                root[high] = low
                a.append(low)
                b.append(high)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []
        for batch in slices(batches, "text"):
            for *key, i, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingle_sets(unpacked(batch.column(4)), words)):
                if key != cell:
                    if len(ids) > 1:
                        yield forest(ids, sets)
                    cell, ids, sets = key, [], []
                # Rows that share a key share a place.
                if not ids or ids[-1] != i:
                    ids.append(i)
                    sets.append(s)
        if len(ids) > 1:
            yield forest(ids, sets)

    return cells.join(docs, "id").select("bucket", "i", "j", "id", "text").repartition(
        "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(run, ddl)


def _together(members: DataFrame) -> DataFrame:
    """(bucket, id, n): buckets that share members, as one where that puts fewer rows into cells than each by itself.

    Members of a large group of like texts that are no links meet in most of their buckets, and each would compare them
    again.  A group holds every bucket it replaces, so no pair is lost.
    """
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"))
    led = durable(members.select("bucket", "id", "n").join(heads, "bucket"))
    groups = components(durable(led.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()))
    # The smallest member of a group is no key of its own.
    placed = durable(led.join(groups.select(F.col("key").alias("id"), "component"), "id", "left").select(
        F.coalesce("component", "id").alias("group"), "bucket", "id", "n"))
    apart = placed.groupBy("group", "bucket").agg(F.first("n").alias("n")).groupBy("group").agg(
        F.sum(_cell_rows("n")).alias("apart"))
    whole = placed.select("group", "id").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("size")).join(apart, "group").select(
        "group", "size", (_cell_rows("size") <= F.col("apart")).alias("whole"))
    judged = durable(placed.join(whole, "group"))
    forget(led, placed)
    return judged.filter("NOT whole").select("bucket", "id", "n").unionByName(
        judged.filter("whole").select(F.xxhash64("group").alias("bucket"), "id", F.col("size").alias("n")).distinct())


def _cell_rows(n: str):
    return F.col(n) * F.ceil(F.col(n) / BLOCK)


def _cells(members: DataFrame) -> DataFrame:
    """(bucket, i, j, id): cells of two blocks of a bucket, so that any two members meet in one."""
    blocks = F.ceil(F.col("n") / BLOCK)
    return members.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), blocks)).select(
        "bucket", "id", "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id")


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), bins: int = BINS,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: key, n_shingles, component_id (smallest key reachable) and kept.

    Null, empty and blank texts have no shingles and link with nothing.  Rows that share a key each have a
    result; where links are confirmed, either text will do.  A row with a null key links with nothing; its component is null and
    it is kept.  Columns besides key and text are not read.
    """
    threshold = share[0] / share[1]
    rows = band_rows(threshold, bins)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = durable(sign(source, words, [(bins, rows, 0)]))
    linkable = signed.filter("id IS NOT NULL AND n_shingles > 0")
    # A class comes with its own bands, so no join has to bring them.
    classes = durable(linkable.groupBy("set_id").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))
    reps = classes.select(F.col("rep").alias("id"), "size", "bands")
    texts, labels = pack(source), None
    rounds = [[], *later_rounds(threshold, rows)]
    for number, signers in enumerate(rounds):
        last = number == len(rounds) - 1
        banded = reps if not number else sign(texts, words, signers).select("id", F.col("n_shingles").alias("size"), "bands")
        buckets = banded.select("id", "size", F.explode("bands").alias("bucket"))
        if number:
            buckets = durable(buckets.distinct())
        members = durable(_mixed(buckets, labels))
        # Texts of candidates are gathered once, by one plan at every size, in buckets of their ids, so that no
        # confirmation shuffles more of them than it compares; later rounds take theirs from these.
        earlier = texts
        texts = durable_by(texts.join(members.select("id").distinct().hint("merge"), "id"), "id")
        if number:
            forget(earlier, buckets)
        stars = durable(_stars(members, share))
        labels = _joined(durable(confirm(stars.filter("first").select("hub", "id"), texts, words, share)), labels)
        others = durable(_between(stars.filter("NOT first"), labels))
        labels = _joined(durable(confirm(others, texts, words, share)), labels)
        # Every pair of a bucket of two was one of a hub.
        left = durable(_mixed(members, labels).filter("n > 2"))
        listed = durable(_between(_listed(left.filter(F.col("n") <= LISTED), share).join(stars, ["hub", "id"], "left_anti").join(
            stars.select(F.col("hub").alias("id"), F.col("id").alias("hub")), ["hub", "id"], "left_anti"), labels))
        large = left.filter(F.col("n") > LISTED)
        here = large if last else large.filter(F.col("n") <= MEMBERS)
        labels = _joined(durable(confirm(listed, texts, words, share).unionByName(
            confirm_cells(_cells(_together(here)), texts, words, share))), labels)
        inside = None if last else durable(_mixed(large.filter(F.col("n") > MEMBERS), labels).select("id").distinct())
        forget(members, stars, others, left, listed)
        if last or inside.isEmpty():
            break
        texts, earlier = durable(texts.join(inside.hint("merge"), "id")), texts
        forget(earlier, inside)
    forget(texts)
    placed = signed.join(classes.select("set_id", "rep"), "set_id", "left").join(
        labels.withColumnRenamed("key", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return placed.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(component).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.lit(True)).otherwise(
            F.coalesce(F.col("id") == component, F.lit(True))).alias("kept"))
