"""JSON documents of any size, cut into one small document for each member, without reading any of them whole.

A file is read in pieces between commas, by as many tasks as it has blocks, whether or not it has line ends.  A comma
separates members if it stands outside strings at depth one (members of the root) or two (members of a container of
the root).  Both are sums over what comes before: quotes modulo two say whether a string is open, brackets outside
strings give the depth.  They are summed in two steps.  A first scan gives a row for each block: its quotes, its brackets
if a string is open at its start and if not, and how many commas stand at which depth.  Sums of those rows say how each
block starts, and a second scan cuts it.  So a document may span any number of tasks, and its text is not shuffled.

Each part between separating commas becomes a document of its own, with the brackets and the name of the container
that it stands in: of ``{"version": 1, "keys": {"a": {…}, "b": {…}}}`` come ``{"version": 1}``, ``{"keys": {"a": {…}}}``
and ``{"keys": {"b": {…}}}``.  Parsers of whole documents take these, and the size of a document has no limit but that
of one member.  A document counts as well-formed if all its parts are, nothing is open at its end, nothing follows it
and no comma stands where no member does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.session import durable, forget, ship_package, shuffled
from lexilake.sinks.documents import FEW_DOCUMENTS, MANIFEST
from lexilake.sources.documents import is_absent, once, parse_once, take_repeated_members

DOCUMENT = ["project", "path"]
_NAME = r'("(?:[^"\\]|\\.)*")'


def read_blocks(spark: SparkSession, path: str, separator: str, glob: str | None = None,
                project_pattern: str | None = None) -> DataFrame:
    """(project, path, file, block, at, file_size, text): what stands between separators, in order of block and ``at``.

    ``block`` is where a task's share of the file starts.  Written once, as a second run might number otherwise.
    """
    read = _text_lines(spark, path, separator, glob)
    project = F.regexp_extract("_metadata.file_path", project_pattern, 1).cast("int") if project_pattern else F.lit(0)
    file = F.col("_metadata.file_path")
    return durable(read.select(
        project.alias("project"), file.alias("path"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("text")))


def _text_lines(spark: SparkSession, path: str, separator: str, glob: str | None) -> DataFrame:
    return spark.read.text(path, lineSep=separator, recursiveFileLookup=True, **({"pathGlobFilter": glob} if glob else {}))


def _pieces_of_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, file, block, at, file_size, text) of files of one document each, in order within a task."""
    file = F.col("_metadata.file_path")
    return _text_lines(spark, path, ",", glob).select(
        file.alias("path"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("text"))


def _pieces_of_parts(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """As ``_pieces_of_files``, of what ``write_documents`` wrote, with the blocks of a document in order of its parts."""
    return spark.read.text(path, lineSep=",").select(
        F.col("project").cast("int").alias("project"), _named(ids).alias("path"), F.col("_metadata.file_path").alias("file"),
        (F.shiftleft(F.col("part").cast("long"), 40) + F.col("_metadata.file_block_start")).alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("text"))


def _named(ids: list[str]) -> Column:
    return F.concat_ws("/", *[F.concat(F.lit(f"{i}="), F.col(i).cast("string")) for i in ids])


def _torn(spark: SparkSession, path: str, ids: list[str], sums: DataFrame) -> DataFrame:
    """Documents that lack a part of their manifest, or bytes of one."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").select(
        F.col("project").cast("int").alias("project"), _named(ids).alias("path"), F.col("part").cast("long").alias("part"), "bytes")
    sizes = sums.select(*DOCUMENT, F.shiftright("block", 40).alias("part"), "file", "file_size").distinct().groupBy(*DOCUMENT, "part").agg(
        F.sum("file_size").alias("found"))
    return manifest.join(sizes, [*DOCUMENT, "part"], "left").filter(~F.col("found").eqNullSafe(F.col("bytes"))).select(*DOCUMENT).distinct()


def blocks_of(docs: DataFrame) -> DataFrame:
    """The pieces of documents that are rows (project, path, text)."""
    pieces = docs.select(*DOCUMENT, F.posexplode(F.split("text", ",", -1)).alias("at", "text"), F.size(F.split("text", ",", -1)).alias("_n"))
    return pieces.select(*DOCUMENT, F.lit(0).cast("long").alias("block"), F.col("at").cast("long").alias("at"), "text",
                         (F.col("at") < F.col("_n") - 1).alias("ended"))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


_SPECIAL = np.zeros(256, dtype=bool)
_SPECIAL[list(b'"\\{}[]')] = True


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each starts."""
    wide = pa.types.is_large_string(text.type)
    at = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0]:at[-1]], at - at[0]


def _measure(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: quotes, brackets opened if the first piece starts outside a string, if inside one, and whether it
    ends in half an escape.  No escape in JSON begins before a comma."""
    n, broken = len(at) - 1, np.zeros(len(at) - 1, dtype=bool)
    place = np.flatnonzero(_SPECIAL[data])
    kind, piece = data[place], np.searchsorted(at[1:], place, "right")
    slash = np.flatnonzero(kind == 92)
    if len(slash):
        where, of = place[slash], piece[slash]
        new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1] + 1) | (of[1:] != of[:-1])]))
        length = np.diff(np.append(new, len(where)))
        odd = length % 2 == 1
        follows, of = (where[new] + length)[odd], of[new][odd]
        inside = follows < at[of + 1]
        broken[of[~inside]] = True
        keep = (kind != 92) & ~np.isin(place, follows[inside])
        kind, piece = kind[keep], piece[keep]
    quote = kind == 34
    open_ = np.cumsum(quote) % 2 == 1
    step = np.where(quote, 0, np.where((kind == 123) | (kind == 91), 1, -1))
    total = lambda which: np.bincount(piece[which], weights=step[which], minlength=n).astype(np.int64)
    return np.bincount(piece[quote], minlength=n), total(~open_ & ~quote), total(open_ & ~quote), broken


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """Where rows of equal keys that follow each other begin and end."""
    changed = np.zeros(batch.num_rows - 1, dtype=bool)
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        changed |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    return list(zip(cuts, cuts[1:]))


BLOCK = ["project", "path", "block"]
_SUMS = ("project int, path string, block long, file string, file_size long, bytes long, given boolean, q int, s0 long, s1 long, "
         "depths0 array<long>, counts0 array<long>, depths1 array<long>, counts1 array<long>")


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block.  The last piece of a block is left out of the commas, as none may follow it."""
    out, schema = [], _schema(_SUMS)
    key, now = None, None

    def done() -> dict:
        pairs = [sorted(c.items()) for c in now["commas"]]
        return {k: now[k] for k in ("file", "file_size", "bytes", "given", "q", "s0", "s1")} | dict(zip(BLOCK, key)) | {
            f"{name}{i}": [x[j] for x in pairs[i]] for i in (0, 1) for j, name in enumerate(("depths", "counts"))}

    for batch in batches:
        if not batch.num_rows:
            continue
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for a, b in _runs(batch, BLOCK):
            at_row = tuple(column[c][a].as_py() for c in BLOCK)
            if at_row != key:
                if now is not None:
                    out.append(done())
                key, now = at_row, {"file": column["file"][a].as_py(), "file_size": column["file_size"][a].as_py(), "bytes": 0, "q": 0,
                                    "s0": 0, "s1": 0, "commas": (Counter(), Counter()), "last": None}
            data, at = _bytes_of(column["text"].slice(a, b - a))
            quotes, even, odd, _ = _measure(data, at)
            if now["q"]:
                even, odd = odd, even
            parity = (now["q"] + np.cumsum(quotes)) % 2
            depths = now["s0"] + np.cumsum(even), now["s1"] + np.cumsum(odd)
            for i in (0, 1):
                kinds, counts = np.unique(depths[i][:-1][parity[:-1] == i], return_counts=True)
                now["commas"][i].update(dict(zip(kinds.tolist(), counts.tolist())))
                if now["last"] is not None and now["last"][0] == i:
                    now["commas"][i][now["last"][1 + i]] += 1
            now["last"] = int(parity[-1]), int(depths[0][-1]), int(depths[1][-1])
            now["q"], now["s0"], now["s1"] = now["last"]
            now["bytes"] += len(data) + b - a
            now["given"] = column["ended"][b - 1].as_py()
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        out.append(done())
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _starts(sums: DataFrame) -> DataFrame:
    """How each block starts: in a string or not, at which depth, after how many cuts, and if within a member or a piece."""
    whole, file = Window.partitionBy(*DOCUMENT).orderBy("block"), Window.partitionBy("file")
    # Without a separator at its end a file is a byte shorter than its pieces with separators.
    cut_short = (F.sum("bytes").over(file) > F.col("file_size")) & (F.col("block") == F.max("block").over(file))
    ended = sums.withColumn("ended", F.coalesce("given", ~cut_short))
    parity = ended.withColumn("parity", (_before(F.col("q"), whole) % 2).cast("int"))
    outside = F.col("parity") == 0
    based = parity.withColumn("delta", F.when(outside, F.col("s0")).otherwise(F.col("s1"))).withColumn("base", _before(F.col("delta"), whole))
    after = F.col("base") + F.col("delta")
    last = F.col("ended") & ((F.col("parity") + F.col("q")) % 2 == 0)

    def cuts(most: int) -> Column:
        commas = F.zip_with(F.when(outside, F.col("depths0")).otherwise(F.col("depths1")), F.when(outside, F.col("counts0")).otherwise(
            F.col("counts1")), lambda d, n: F.when(d <= most - F.col("base"), n).otherwise(0))
        return F.aggregate(commas, F.lit(0).cast("long"), lambda a, n: a + n) + (last & (after <= most)).cast("long")

    counted = based.withColumn("c", cuts(2)).withColumn("r", cuts(1)).withColumn("_cut", last & (after <= 2)).withColumn("_root", last & (after <= 1))
    return counted.select(
        *BLOCK, "parity", "base", F.col("ended").alias("last_ended"), _before(F.col("c"), whole).alias("cuts"), _before(F.col("r"), whole).alias("roots"),
        F.coalesce(~F.lag("_cut").over(whole), F.lit(False)).alias("joined"), F.coalesce(F.lag("_root").over(whole), F.lit(True)).alias("fresh"),
        F.lead("block").over(whole).isNotNull().alias("followed"))


_OPENER = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:\s*([\[{])')
_ROOT = re.compile(rb"\s*\{")
_PIECES = ("project int, path string, block long, member long, piece long, kind string, text string, start long, depth long, open boolean, "
           "cut boolean, broken boolean, first boolean, carried boolean, name string, bracket string")


class _Cutter:
    """One block while it is cut: what stands before the next row, and what was read since the last cut."""

    def __init__(self, key: tuple, row: dict) -> None:
        self.key, self.parity, self.depth, self.start = key, row["parity"], row["base"], row["base"]
        self.member, self.piece, self.first = row["roots"], row["cuts"], row["fresh"] and not row["joined"]
        self.fragment, self.followed, self.last_ended = row["joined"], row["followed"], row["last_ended"]
        self.pending, self.broken, self.waiting = [], False, False
        #: The name and bracket of the member that is open, once its first piece was seen.
        self.opener = None

    def take(self, text: pa.Array, at_end: bool) -> list[dict]:
        """The pieces that the next rows end; ``at_end``: no more rows follow in the block."""
        data, at = _bytes_of(text)
        quotes, even, odd, broken = _measure(data, at)
        parity = (self.parity + np.cumsum(quotes)) % 2
        depth = self.depth + np.cumsum(odd if self.parity else even)
        ended = np.ones(len(text), dtype=bool)
        if at_end:
            ended[-1] = self.last_ended
        cut = ended & (parity == 0) & (depth <= 2)
        comma = ended & ~cut
        # The bytes with the commas that do not cut.
        size = np.diff(at) + comma
        end = np.cumsum(size)
        joined = np.full(int(end[-1]), 44, dtype=np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.cumsum(comma) - comma, np.diff(at))] = data
        joined, out, before = joined.tobytes(), [], 0
        bad = np.cumsum(broken)
        bad_before = 0
        for i in np.flatnonzero(cut).tolist():
            self._close(out, joined[before:end[i]], bad[i] > bad_before, int(depth[i]), False, True, False)
            before, bad_before = int(end[i]), bad[i]
            root = depth[i] <= 1
            self.start, self.first = int(depth[i]), bool(root)
            self.member, self.piece = self.member + int(root), self.piece + 1
            self.opener = None if root else self.opener
        if not cut[-1]:
            self.pending.append(joined[before:])
            self.broken |= bool(bad[-1] > bad_before)
            self.waiting = True
        self.parity, self.depth = int(parity[-1]), int(depth[-1])
        if at_end:
            if self.waiting:
                self._close(out, b"", False, self.depth, self.parity == 1, False, self.followed)
            if self.followed and self.opener is not None:
                out.append(self._row("opener", b"", False, False, 0, False))
        return out

    def _close(self, out: list, text: bytes, broken: bool, depth: int, open_: bool, cut: bool, fragment: bool) -> None:
        text = b"".join([*self.pending, text])
        fragment |= self.fragment
        if self.first and not fragment:
            head = _ROOT.match(text) if self.member == 0 else None
            found = _OPENER.match(text, head.end() if head else 0)
            self.opener = found.groups() if found else (b"", b"")
        out.append(self._row("fragment" if fragment else "whole", text, broken or self.broken, open_, depth, cut))
        self.pending, self.broken, self.waiting, self.fragment = [], False, False, False

    def _row(self, kind: str, text: bytes, broken: bool, open_: bool, depth: int, cut: bool) -> tuple:
        name, bracket = self.opener or (None, None)
        return (*self.key, self.member, self.piece, kind, text, self.start, depth, open_, cut, broken, self.first, self.opener is None, name, bracket)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of blocks, of rows that have the columns of ``_starts`` beside them."""
    schema = _schema(_PIECES)
    raw = [pa.binary() if pa.types.is_string(f.type) and f.name in ("text", "name", "bracket") else f.type for f in schema]

    def made(rows: list) -> pa.RecordBatch:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), raw)] if rows else [pa.array([], t) for t in raw]
        # The bytes are those of the files, as a text source gives them.
        return pa.RecordBatch.from_arrays([c.view(f.type) if pa.types.is_binary(c.type) else c for c, f in zip(columns, schema)], schema=schema)

    held = cutter = None

    def pieces(batch: pa.RecordBatch, whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal cutter
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        runs, out = _runs(batch, BLOCK), []
        for a, b in runs:
            key = tuple(column[c][a].as_py() for c in BLOCK)
            if cutter is None or cutter.key != key:
                cutter = _Cutter(key, {c: column[c][a].as_py() for c in STARTS})
            # The last row waits for the next batch, which tells whether its block goes on.
            end = whole or b < batch.num_rows
            upto = b if end else b - 1
            if upto > a:
                out += cutter.take(column["text"].slice(a, upto - a), end)
        yield made(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        yield from pieces(batch, False)
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield from pieces(held, True)


STARTS = ["parity", "base", "last_ended", "cuts", "roots", "joined", "fresh", "followed"]


def _before(total: Column, window) -> Column:
    return F.coalesce(F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def block_sums(pieces: DataFrame, project: Column | None = None) -> DataFrame:
    """A row for each block of pieces that are in order, stored; ``project`` is made of its path, where it is no column."""
    ship_package(pieces.sparkSession)
    own = F.col("project") if project is None else F.lit(None).cast("int")
    given = F.col("ended") if "ended" in pieces.columns else F.lit(None).cast("boolean")
    sums = pieces.select(own.alias("project"), "path", "block", "file", "file_size", given.alias("ended"), "text").mapInArrow(_sum_blocks, _SUMS)
    return durable(sums if project is None else sums.withColumn("project", project))


def _in_order(pieces: DataFrame) -> DataFrame:
    keys = [c for c in BLOCK if c in pieces.columns]
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "at")


def members(blocks: DataFrame) -> DataFrame:
    """(project, path, member, piece, v, good) of the pieces (project, path, block, at, text, ended) of JSON documents.

    ``member`` numbers the members of the root, ``piece`` the small documents in order, ``v`` is one as a variant.  A
    document is well-formed if all of its rows are ``good``.
    """
    named = durable(blocks.withColumn("file", F.col("path")).withColumn("file_size", F.lit(0).cast("long")))
    return _members(named, block_sums(_in_order(named)), False)


def _members(pieces: DataFrame, sums: DataFrame, in_order: bool) -> DataFrame:
    """As ``members``; ``in_order``: each block is read by one task, row by row, with no other block between."""
    starts = durable(_starts(sums))
    keys = [c for c in BLOCK if c in pieces.columns]
    rows = pieces.select(*keys, "at", "text")
    if in_order and starts.count() <= FEW_DOCUMENTS:
        # A join by shuffle would lose the order of the rows; the starts are a bounded number of short rows.
        met = rows.join(F.broadcast(starts), keys)
    else:
        met = _in_order(rows.join(shuffled(starts), keys))
    cut = durable(met.select(*BLOCK, "text", *STARTS).mapInArrow(_cut_blocks, _PIECES))
    plain = F.when(F.col("member") == 0, F.regexp_replace("text", r"\A\s*\{", "")).otherwise(F.col("text"))
    opener = lambda n: F.regexp_extract(plain, rf"\A\s*{_NAME}\s*:\s*([\[{{])", n)
    # Pieces that span blocks: at most two of each block.
    spanning = durable(cut.filter("kind = 'fragment'").groupBy(*DOCUMENT, "member", "piece").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "").alias("text"), F.min_by("start", "block").alias("start"),
        F.max_by("depth", "block").alias("depth"), F.max_by("open", "block").alias("open"), F.bool_or("cut").alias("cut"),
        F.bool_or("broken").alias("broken"), F.min_by("first", "block").alias("first")).withColumn(
        "name", F.when(F.col("first"), opener(1))).withColumn("bracket", F.when(F.col("first"), opener(2))).withColumn("carried", ~F.col("first")))
    openers = durable(cut.filter("kind = 'opener'").select(*DOCUMENT, "member", "name", "bracket").unionByName(
        spanning.filter("first").select(*DOCUMENT, "member", "name", "bracket")))
    columns = [*DOCUMENT, "member", "piece", "text", "start", "depth", "open", "cut", "broken", "carried", "name", "bracket"]
    pieces = cut.filter("kind = 'whole'").select(*columns).unionByName(spanning.select(*columns))
    # A member that goes on in another block has its name from where it began.
    named = pieces.filter("carried").drop("name", "bracket").join(
        openers if openers.count() <= FEW_DOCUMENTS else shuffled(openers), [*DOCUMENT, "member"], "left")
    framed = pieces.filter("NOT carried").unionByName(named)
    head = F.when(F.col("start") == 1, "{").when(F.col("start") == 2, F.concat(F.lit("{"), "name", F.lit(":"), "bracket")).otherwise("")
    tail = F.when(F.col("depth") == 1, "}").when(
        F.col("depth") == 2, F.when(F.col("bracket") == "{", "}}").otherwise("]}")).otherwise("")
    at_end = ~F.col("cut")
    wrong = (
        F.col("broken") | F.col("open") | ~F.col("start").between(0, 2) | ~F.col("depth").between(0, 2)
        # The end of a document is at depth zero, and no comma is.
        | (at_end != (F.col("depth") == 0))
        | (((F.col("start") == 2) | (F.col("depth") == 2)) & (F.coalesce("bracket", F.lit("")) == ""))
        # Where a member should stand there is none.
        | ((F.col("start") > 0) & F.col("text").rlike(r"\A\s*([}\]]|\z)")) | (F.col("cut") & F.col("text").rlike(r"([{\[]|\A)\s*\z"))
        | ((F.col("piece") == 0) & ~F.col("text").rlike(r"\A\s*\{")))
    made = parse_once(framed, "v", F.concat(head, "text", tail))
    out = made.select(*DOCUMENT, "member", "piece", "v", (F.col("v").isNotNull() & ~F.coalesce(wrong, F.lit(True))).alias("good"))
    out._reads = [starts, cut, spanning, openers]
    return out


def read_members(spark: SparkSession, path: str, glob: str | None = None, project_pattern: str | None = None,
                 ids: list[str] | None = None) -> DataFrame:
    """The members of every document below ``path``: of its parts, where a manifest lists them, else of every file.

    ``ids`` are the columns that name a document of a manifest.  An empty file, and a document without all its parts,
    has a row that is not good.
    """
    take_repeated_members(spark)
    if ids and has_manifest(spark, path):
        pieces = _pieces_of_parts(spark, path, ids)
        sums = block_sums(pieces)
        unusable = _torn(spark, path, ids, sums)
    else:
        pieces = _pieces_of_files(spark, path, glob)
        sums = block_sums(pieces, F.regexp_extract("path", project_pattern, 1).cast("int") if project_pattern else F.lit(0))
        unusable = _empty_files(spark, _text_lines(spark, path, ",", glob), sums, project_pattern)
    found = _members(pieces, sums, True)
    stored = durable(found.unionByName(_unusable(unusable)))
    forget(sums, *found._reads)
    return stored


def has_manifest(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _unusable(docs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return docs.select(*DOCUMENT, zero.alias("member"), zero.alias("piece"), F.try_parse_json(F.lit("")).alias("v"), F.lit(False).alias("good"))


def _empty_files(spark: SparkSession, read: DataFrame, rows: DataFrame, project_pattern: str | None) -> DataFrame:
    """(project, path) of the files without a byte, which Spark leaves out of a scan.

    Their names are those of the files that the driver listed for the scan and that gave no row.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    listed = spark.createDataFrame([(f,) for f in read.inputFiles()], "path string").withColumn("_plain", plain(F.col("path")))
    silent = listed.join(rows.select(plain(F.col("file")).alias("_plain")).distinct(), "_plain", "left_anti").select("path").collect()
    empty = []
    for row in silent:
        file = path(spark.sparkContext._jvm.java.net.URI(row.path))
        if file.getFileSystem(conf).getFileStatus(file).getLen() == 0:
            empty.append((row.path,))
    project = F.regexp_extract("path", project_pattern, 1).cast("int") if project_pattern else F.lit(0)
    return spark.createDataFrame(empty, "path string").select(project.alias("project"), "path")


def of_documents(rows: DataFrame, **values: Column) -> DataFrame:
    """A row per document: ``good``, and of each named root member its last value, made of ``v``, and its number."""
    def last(name, value):
        there = F.when(~is_absent(F.col("v"), f"$.{name}"), F.struct("member", "piece"))
        return [F.max_by(value, there).alias(name), F.max(there)["member"].alias(f"{name}_member")]

    return rows.groupBy(*DOCUMENT).agg(
        F.bool_and("good").alias("good"), *[c for name, value in values.items() for c in last(name, value)])


def keyed(rows: DataFrame, docs: DataFrame, container: str, values: Column) -> DataFrame:
    """(project, path, key, item) of the members of ``container``, of equal names the last.

    ``values`` makes ``item`` of the member as the variant ``_v``.
    """
    found = rows.filter(~is_absent(F.col("v"), f"$.{container}")).join(
        docs.select(*DOCUMENT, F.col(f"{container}_member").alias("member")), [*DOCUMENT, "member"]).select(
        *DOCUMENT, "piece", F.explode(F.try_variant_get("v", f"$.{container}", "map<string,variant>")).alias("key", "_v"))
    return found.select(*DOCUMENT, "piece", "key", values.alias("item")).groupBy(*DOCUMENT, "key").agg(F.max_by("item", "piece").alias("item"))
