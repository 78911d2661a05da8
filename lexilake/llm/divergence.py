"""How the word use of each source differs from the other sources of its language and from the language itself.

A group is a language and a source, each row of the documents one document; its terms are runs of letters, in lower
case from A to Z.  A language keeps the terms of at least ``min_documents`` of its documents.  A group gives each kept
term the whole number 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), where N counts the group's kept terms
and V the language's distinct ones; all arithmetic is on whole numbers, with decimals of 38 digits where 64 bits may
not do.

* **Pairs of sources** differ by the sum over all kept terms.  The kept counts of a language are cut into blocks of
  terms, a task makes the numbers of a block for all sources of the language, zero counts included, and sums the
  differences of each pair, and the sums of the blocks are added.
* **Terms of a group** are ranked by what they have above the language.  A term's number rises with its count in the
  group and falls, against the language's, with its count there, whatever the totals turn out to be.  So a term is
  never among the first k if k others have at least its count in the group, at most its count in the language and
  come earlier where both are the same: it is outside the k-skyband of this dominance.  Each partition keeps the
  skyband of its own terms, the skybands are merged by group, and only what is left is scored and ranked exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.llm.shared import durable, pa_schema, ship_package, slices

SCALE, SMOOTH = 1_000_000_000, 5
MIN_DOCUMENTS, TOP_TERMS = 30, 50
#: Kept counts in a block of terms, and numbers a task compares at a time.
BLOCK_ROWS, CHUNK_NUMBERS = 200_000, 4_000_000
#: Terms of documents that a task gathers before it counts them, and rows it compares with a skyband at a time.
COUNTED_TERMS, SKYBAND_ROWS = 500_000, 512
#: Shares of a group's terms whose skybands are merged first, so that no task meets those of all partitions.
SHARES = 16

_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and rows that have it, from each task's documents."""
    ship_package(docs.sparkSession)
    ddl = "lang string, source string, term string, n long, docs long"
    out = pa_schema(docs.sparkSession, ddl)

    def flush(groups: dict, words: list, ns: list, of: list) -> pa.RecordBatch:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        at = np.repeat(np.array([g for g, _ in of], dtype=np.int64), [k for _, k in of])
        cell, place = np.unique(at * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
        n = np.zeros(len(cell), dtype=np.int64)
        np.add.at(n, place, np.array(ns, dtype=np.int64))
        group, term = np.divmod(cell, len(coded.dictionary))
        names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([
            *names, coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n),
            pa.array(np.bincount(place, minlength=len(cell)).astype(np.int64))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, words, ns, of = {}, [], [], []
        for batch in slices(batches, "text"):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(text.encode().translate(_TERM_BYTES).split())
                of.append((groups.setdefault((lang, source), len(groups)), len(found)))
                words.extend(found)
                ns.extend(found.values())
            if len(words) > COUNTED_TERMS:
                yield flush(groups, words, ns, of)
                groups, words, ns, of = {}, [], [], []
        if words:
            yield flush(groups, words, ns, of)

    return docs.mapInArrow(run, ddl)


def number(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    wide = "decimal(20,0)"
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast(wide)).alias("o")
    under = (total + SMOOTH * terms).cast(wide)
    return F.lit(1) + F.call_function("div", over, under)


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's (lang, source, term, n, lang_n) the rows that fewer than k others of their group dominate.

    Rows come sorted by group, falling n, rising lang_n and term, so a row's dominators come before it, and it is
    enough to count those that stayed: if k dominate it, k that stay do.
    """
    ship_package(rows.sparkSession)
    ddl = "lang string, source string, term string, n long, lang_n long"
    out = pa_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, low, last = None, np.zeros(0, np.int64), []
        for batch in batches:
            for at in range(0, batch.num_rows, SKYBAND_ROWS):
                part = batch.slice(at, SKYBAND_ROWS)
                langs, sources, terms = (part.column(i).to_pylist() for i in range(3))
                lang_n = part.column(4).to_numpy(zero_copy_only=False)
                text = [t.encode() for t in terms]
                groups = list(zip(langs, sources))
                first = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
                keep = np.zeros(len(groups), dtype=bool)
                for a, b in zip(first, first[1:]):
                    if groups[a] != group:
                        group, low, last = groups[a], np.zeros(0, np.int64), []
                    # The order of all terms at hand stands for the terms.
                    known = sorted({*last, *text[a:b]})
                    rank = {t: i for i, t in enumerate(known)}
                    low_rank = np.array([rank[t] for t in last], dtype=np.int64)
                    own, own_rank = lang_n[a:b], np.array([rank[t] for t in text[a:b]], dtype=np.int64)
                    before = ((low[None, :] <= own[:, None]) & (low_rank[None, :] < own_rank[:, None])).sum(axis=1)
                    alive = np.flatnonzero(before < k)
                    inside = np.tril((own[alive][None, :] <= own[alive][:, None])
                                     & (own_rank[alive][None, :] < own_rank[alive][:, None]), -1).sum(axis=1)
                    stay = alive[before[alive] + inside < k]
                    keep[a + stay] = True
                    low = np.concatenate([low, own[stay]])
                    last.extend(text[a + i] for i in stay.tolist())
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(keep)) for c in (part.column(i) for i in range(5))], schema=out)

    order = ["lang", "source", F.desc("n"), "lang_n", "term"]
    return rows.select("lang", "source", "term", "n", "lang_n").sortWithinPartitions(*order).mapInArrow(run, ddl)


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source with each other of its language."""
    ship_package(kept.sparkSession)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS))
    sides = groups.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source",
        F.when(F.col("v") > 0, number(F.lit(0), F.col("total"), F.col("v"))).otherwise(0).alias("zero"))
    cells = kept.join(groups.select("lang", "source", "total", "v", "rows"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term",
        number(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    def compare(side: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("source", ignore_index=True)
        n, zero = len(side), side["zero"].to_numpy(np.int64)
        source = pd.Index(side["source"]).get_indexer(cell["source"])
        term, names = pd.factorize(cell["term"])
        order = np.argsort(term, kind="stable")
        source, term, p = source[order], term[order], cell["p"].to_numpy(np.int64)[order]
        sums = np.zeros((n, n), dtype=np.int64)
        step = max(1, CHUNK_NUMBERS // max(n, 1))
        for low in range(0, len(names), step):
            a, b = np.searchsorted(term, (low, low + step))
            numbers = np.repeat(zero[:, None], min(step, len(names) - low), axis=1)
            numbers[source[a:b], term[a:b] - low] = p[a:b]
            for i in range(n - 1):
                sums[i, i + 1:] += np.abs(numbers[i + 1:] - numbers[i]).sum(axis=1)
        i, j = np.triu_indices(n, 1)
        name = side["source"].to_numpy()
        return pd.DataFrame({"lang": side["lang"].iloc[0] if n else None, "a": name[i], "b": name[j], "value": sums[i, j]})

    added = sides.groupBy("lang", "block").cogroup(cells.groupBy("lang", "block")).applyInPandas(
        compare, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return added.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p")).select("lang", "p.source", "p.item", "value")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, text: str = "text",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) as above: part ``pair`` whole, part ``term`` to rank ``top``.

    Null texts, languages and sources are empty ones.  Every row is a document, so repeated rows count again.  A
    group without kept terms still differs from others; where a language keeps none, all values are 0.  Equal values
    are ranked by item in UTF-8 order.  A language of one source has no pairs; an empty table gives no rows.  Columns
    besides these three are not read, whatever their names.
    """
    spoken = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    # One shuffle by language and term serves the groups' counts and the language's.
    counted = count_terms(spoken).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    kept = durable(counted.withColumns({
        "lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole),
        "first": F.col("source") == F.min("source").over(whole),
    }).filter(F.col("lang_docs") >= min_documents).drop("docs", "lang_docs"))
    totals = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("rows"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = durable(spoken.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(
        totals, "lang", "left").fillna(0, ["total", "v", "lang_total", "rows"]))
    first = skyband(kept, top).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SHARES)))
    merged = skyband(skyband(first, top).repartition("lang", "source"), top)
    excess = number(F.col("n"), F.col("total"), F.col("v")) - number(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = merged.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    pairs = _pair_sums(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(terms.select("*", place).filter(F.col("rank") <= top))
