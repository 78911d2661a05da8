"""Fill-in-the-middle forms of documents, from columnar kernels over whole batches.

A unit is a run of non-space with the space before it; the space that ends a text is a unit of its own.  Two
hashed cuts make prefix, middle and suffix, and a hashed draw leaves the text plain or puts the pieces in one of
two orders behind sentinels.  The pipeline of each batch, without a loop over rows or units:

1. a mark after every unit, a byte that UTF-8 never uses, and a split at the marks: a list of units for each row;
2. the lists flattened, each unit with the row it came from and its ordinal there;
3. for each role (prefix, middle, suffix) the units filtered by their ordinal against their row's cuts;
4. lists rebuilt from the counts of each row's units that were kept, and joined to one piece for each row;
5. pieces and sentinels joined element by element.

A text that holds a sentinel stays plain, and a sentinel never arises where a piece meets one, as none starts with
another's end.  So ``restore`` takes any output back to its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.llm.shared import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARK = b"\xff"
#: Per cent of documents that stay plain, and of the others that become suffix-prefix-middle.
PLAIN_PERCENT, SPM_PERCENT = 50, 80
_BINARY = pa.large_binary()


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed`` and the key's digits; a null key has none."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _joined(*columns) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(c, _BINARY) if isinstance(c, bytes) else c for c in columns],
                                       pa.scalar(b"", _BINARY))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All units of a batch in order, the row of each, its ordinal in that row, and each row's number of units."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    # What follows a row's last mark is empty, and no unit is.
    filled = pc.not_equal(pc.binary_length(flat), 0)
    flat, parents = flat.filter(filled), parents[filled.to_numpy(zero_copy_only=False)]
    counts = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    starts = np.cumsum(counts) - counts
    return flat, parents, np.arange(len(parents)) - starts[parents], counts


def pieces(flat: pa.Array, parents: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept units of each row as one string."""
    counts = np.bincount(parents[keep], minlength=rows)
    lists = pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), flat.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(b"", _BINARY))


def _characters(strings: pa.Array) -> pa.Array:
    return pc.utf8_length(strings.cast(pa.large_string()))


def transform_batch(texts: pa.Array, h: list[np.ndarray], plain_percent: int = PLAIN_PERCENT,
                    spm_percent: int = SPM_PERCENT) -> dict:
    """Columns n, form, prefix_chars, middle_chars, output of a batch of texts and their draws."""
    texts = texts.cast(_BINARY).fill_null(b"")
    flat, parents, ordinal, n = units(texts)
    cuts = np.stack([h[0] % (n + 1), h[1] % (n + 1)])
    low, high = cuts.min(axis=0), cuts.max(axis=0)
    before, after = ordinal < low[parents], ordinal >= high[parents]
    prefix, middle, suffix = (pieces(flat, parents, keep, len(texts)) for keep in (before, ~(before | after), after))
    held = np.zeros(len(texts), dtype=bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held |= pc.match_substring(texts, pattern=sentinel.encode()).to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | held | (h[2] % 100 >= plain_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    output = pc.if_else(plain, texts, pc.if_else(
        spm, _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle)))
    none = pa.scalar(None, pa.int64())
    return {
        "n": n, "form": pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
        "prefix_chars": pc.if_else(plain, none, _characters(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, _characters(middle).cast(pa.int64())),
        "output": output.cast(pa.large_string()).cast(pa.string())}


def restore_batch(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that the outputs were made of."""
    outputs = outputs.cast(_BINARY).fill_null(b"")
    plain = pc.equal(forms, PLAIN)
    # Three sentinels cut an output into four parts, of which the first is empty.
    lists = pc.split_pattern_regex(pc.if_else(plain, pa.scalar(b"<P><S><M>", _BINARY), outputs), pattern=b"<[PSM]>")
    first, second, last = (pc.list_element(lists, i) for i in (1, 2, 3))
    spm = pc.equal(forms, SPM)
    text = _joined(pc.if_else(spm, second, first), last, pc.if_else(spm, first, second))
    return pc.if_else(plain, outputs, text).cast(pa.large_string()).cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 42, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                   text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: key, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    A null text is empty, and an empty text is plain with no units.  Rows are independent: repeated rows give the
    same row again, and rows with a null key share the draws of an empty key.  Columns besides key and text are not
    read, whatever their names.  An empty table gives no rows.  A narrow step over batches of bounded bytes, so a
    very long text is one batch of its own.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key), seed))])

    def make():
        def run(b: pa.RecordBatch) -> dict:
            h = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            return {key: b.column(0)} | transform_batch(b.column(1), h, plain_percent, spm_percent)

        return run

    return map_rows(rows, make, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, form string, "
                                "prefix_chars long, middle_chars long, output string", "text")


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text, rebuilt from output and form alone, in ``restored``."""
    def make():
        def run(b: pa.RecordBatch) -> dict:
            columns = dict(zip(b.schema.names, b.columns))
            return columns | {"restored": restore_batch(columns["output"], columns["form"])}

        return run

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return map_rows(made, make, f"{ddl}, restored string", "output")
