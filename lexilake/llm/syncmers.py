"""Document fingerprints from closed syncmers, in native Spark functions only.

A text's units are its runs of up to 8 code points without space.  A k-mer is k units in a row; it is an anchor if
the least hash of the s-mers inside it is that of its first or last one.  Whether a k-mer is an anchor depends on
nothing but its own units, so an anchor survives any edit outside it, and every stretch of 2k - s - 1 units holds one.

A fingerprint has anchors at up to three levels, each for texts of some range of lengths that overlaps the next, so
that a text and its edit share a level: single units of short texts, 3-mers of middling ones, 12-mers of long ones.
An anchor is its hash (31 bits) and the number of its first unit, and each distinct anchor of a text is listed once,
where it first stands.  A text with fewer units than 3, at the second level, is one anchor.

Anchors match by position.  Two texts are alike, at a level, by the anchors they share that stand at the same place
in both or have moved by as much as the shared anchor before or after them, over the anchors of the one with more;
the likeness of two fingerprints is that at the best level they share.  It is 1 for equal texts, and 1 for two texts
without units, and 0 for one with and one without.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.llm.shared import durable

UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: For each level k, s and the numbers of units it serves: from, and below (none: no end).
LEVELS = ((1, 1, 1, 24), (3, 1, 1, 128), (12, 2, 48, None))
_SIDE, _PLACE = 1 << 32, (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(values: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` of each value and the next."""
    return _let(F.greatest(F.size(values) - 1, F.lit(0)), lambda n: F.zip_with(
        F.slice(values, 1, n), F.slice(values, 2, n), fn))


def _anchors(h: Column, k: int, s: int) -> Column:
    """Sorted anchors of the unit hashes ``h``: hash in the high 31 bits, a free bit, place in the low 32."""
    inner = h
    for _ in range(s - 1):
        inner = _pairs(inner, lambda a, b: F.xxhash64(a, b))
    width = k - s + 1

    def chosen(m: Column) -> Column:
        places = F.when(F.size(h) >= k, F.sequence(F.lit(1), F.size(h) - (k - 1))).otherwise(F.array().cast("array<int>"))
        if width == 1:
            return places
        return F.filter(places, lambda i: F.array_min(F.slice(m, i, width)) >= F.least(m[i - 1], m[i + (width - 2)]))

    kept = F.transform(_let(inner, chosen), lambda i: F.shiftleft(F.xxhash64(F.slice(h, i, k)), 33).bitwiseOR(
        (i - 1).cast("long")))
    if k > 1:
        # A text too short for a k-mer is one anchor.
        kept = F.when(F.size(h) < k, F.array(F.shiftleft(F.xxhash64(h), 33))).otherwise(kept)
    return _let(F.array_sort(kept), lambda a: F.filter(
        a, lambda x, i: (i == 0) | (F.shiftright(x, 33) != F.shiftright(a[F.greatest(i - 1, F.lit(0))], 33))))


def fingerprint(text: Column) -> Column:
    """The anchors of each level, null at levels that do not serve the text's length."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def levels(h: Column) -> Column:
        n = F.size(h)
        return F.array(*[
            F.when((n >= low) & (F.lit(True) if high is None else n < high), _anchors(h, k, s))
            for k, s, low, high in LEVELS])

    return _let(hashes, levels)


def as_text(anchors: Column) -> Column:
    """A fingerprint as a string: levels apart by ``/``, anchors in hexadecimal in order of hash."""
    return F.array_join(F.transform(anchors, lambda level: F.coalesce(F.array_join(F.transform(
        level, lambda x: F.lower(F.hex(x))), " "), F.lit("-"))), "/")


def _matched(a: Column, b: Column) -> Column:
    """How many anchors of two sorted lists match by position."""
    both = F.array_sort(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(_SIDE)))))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    shared = F.filter(_pairs(both, lambda x, y: F.when(
        F.shiftright(x, 33) == F.shiftright(y, 33), F.struct(place(x).alias("at"), (place(y) - place(x)).alias("moved")))),
        lambda m: m.isNotNull())

    def run(m: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            before, after = m[F.greatest(i - 1, F.lit(0))]["moved"], m[F.least(i + 1, F.size(m) - 1)]["moved"]
            return (x["moved"] == 0) | ((i > 0) & (before == x["moved"])) | ((i < F.size(m) - 1) & (after == x["moved"]))

        return F.size(F.filter(m, stays))

    return _let(F.array_sort(shared), run)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, how much two fingerprints have in common."""
    by_level = F.zip_with(a, b, lambda x, y: F.when(
        x.isNotNull() & y.isNotNull(), _matched(x, y) / F.greatest(F.size(x), F.size(y), F.lit(1))))
    empty = lambda f: F.forall(f, lambda level: level.isNull())
    return F.when(empty(a) & empty(b), F.lit(1.0)).otherwise(F.coalesce(F.array_max(by_level), F.lit(0.0)))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, fingerprint, text): null texts are empty, rows independent; no shuffle."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        key, F.char_length("text").cast("long").alias("n_chars"), as_text(fingerprint(F.col("text"))).alias("fingerprint"), "text")


def _following(groups: DataFrame) -> DataFrame:
    """(row_key, taker, taken, copies) of rows (row_key, id, n_chars, copies) in falling order of id, then of row_key.

    ``taker`` is the row before, ``copies`` its number, and ``taken`` how many code points of this row it takes; the
    last row comes before the first.  Rows are dealt in ranges; only each range's last row meets those of the others.
    """
    order = [F.desc_nulls_last("id"), F.col("row_key")]
    placed = durable(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()))
    taker = F.struct(F.col("row_key").alias("taker"), F.floor(F.col("n_chars") / 3).cast("int").alias("taken"), "copies")
    rows = placed.select("row_key", F.shiftright("at", 33).alias("part"), "at", taker.alias("t"))
    ranges = Window.orderBy("part")
    ends = rows.groupBy("part").agg(F.max_by("t", "at").alias("end")).select(
        "part", F.coalesce(F.lag("end").over(ranges), F.last("end").over(
            ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    before = F.lag("t").over(Window.partitionBy("part").orderBy("at"))
    return rows.select("row_key", "part", before.alias("t")).join(F.broadcast(ends), "part").select(
        "row_key", F.coalesce("t", "end").alias("t")).select("row_key", "t.*")


def edit_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints against those of an edit and of the next document, to see how far they tell them apart.

    The edit of a document: the last third of its code points gives way to as many from the start of the next one, in
    falling order of key, the first following the last.  Returns key, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next and the next document's key.

    Null texts are empty; null keys come last; rows with one key stand in an order of their own (by a hash of key
    and text), and each of several equal rows is followed by the next of them.  A table of one row follows itself.
    Columns besides key and text are not read.  An empty table gives no rows.

    Texts are shuffled once by a hash of the whole row, so copies and hot keys spread, and once more as the part
    that the row before takes, with the anchors it is compared with.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "row_key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), "text").cast("binary"), 256)))
    # Equal rows are one, with their number: one text of each moves.
    follows = durable(_following(rows.groupBy("row_key").agg(
        F.first("id").alias("id"), F.first(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))))
    # Both sides of the join below read all columns of this, so they share its shuffle.
    single = rows.groupBy("row_key").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    given = single.join(follows.hint("merge"), "row_key").select(
        F.col("taker").alias("row_key"), "copies", F.col("id").alias("next_id"),
        F.substring("text", F.lit(1), F.col("taken")).alias("given"), fingerprint(F.col("text")).alias("next"))
    whole = single.join(given, "row_key")
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    own = whole.select("id", "text", "copies", "next_id", "given", "next", fingerprint(F.col("text")).alias("anchors"))
    # All but the last of equal rows are followed by their like.
    followed = own.select("id", "text", "anchors", F.explode(F.filter(F.array(
        F.struct("next_id", "given", "next", F.lit(1).cast("long").alias("times")),
        F.struct(F.col("id").alias("next_id"), F.substring("text", F.lit(1), third).alias("given"), F.col("anchors").alias("next"),
                 (F.col("copies") - 1).alias("times"))), lambda f: f["times"] > 0)).alias("f"))
    edited = followed.select(
        "id", size.cast("long").alias("n_chars"), "anchors", "f.next_id", "f.next", "f.times",
        F.concat(F.substring("text", F.lit(1), size - third), "f.given").alias("edited"))
    compared = edited.withColumn("changed", fingerprint(F.col("edited"))).select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "n_chars", "edited", as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("anchors"), F.col("changed")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next")).alias("near_next"),
        F.col("next_id").cast(docs.schema[key].dataType).alias(f"next_{key}"), "times")
    return compared.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("time", "times")
