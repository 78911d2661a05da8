"""Best-fit packing of documents into training sequences of a fixed length.

Bounded-space online best-fit: a task keeps a fixed number of open sequences, grouped by free space, with
one bit per amount of free space that is on offer.  A piece goes to the open sequence it fills best: the
lowest set bit at or above its length.  When a new sequence is needed and the number of open ones is
reached, the fullest closes.  Documents longer than a sequence are cut into whole sequences and a rest;
only the rest is packed.  The step is narrow: each task packs the documents it reads, and nothing is
shuffled, so the work is the scan, and a lost task is packed again with the same result.

The price of no shuffle is that every task ends with some sequences that are not full: at most
``open_bins`` in number, in practice a handful, against the tens of thousands a task closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexilake.llm.shared import pa_schema, slices
from lexilake.llm.tokens import WordEncoder, encoder
from lexilake.session import ship_package

SEQUENCE_TOKENS = 2048
OPEN_BINS = 1024
#: Sequence ids are task number x 2^40 + number in the task.
TASK_SHIFT = 40

PIECES = "piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open sequences by free space."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.offered = 0
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Where a piece of 1 to ``capacity`` tokens goes: (sequence, offset)."""
        fitting = self.offered >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self.bins[free].pop()
            if not self.bins[free]:
                self.offered ^= 1 << free
            self.open -= 1
        else:
            free, number = self.capacity, self.made
            self.made += 1
            if length < self.capacity and self.open >= self.open_bins:
                self._close_fullest()
        left = free - length
        if left:
            self.bins[left].append(number)
            self.offered |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _close_fullest(self) -> None:
        least = (self.offered & -self.offered).bit_length() - 1
        self.bins[least].pop()
        if not self.bins[least]:
            self.offered ^= 1 << least
        self.open -= 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS,
                   end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: the document's key, piece number, start, length, ids, their CRC-32, sequence and offset.

    A null or empty text is its end id alone, a piece of one token.  Rows are independent: repeated keys or
    texts are packed once each, a null key stays null.  Columns besides key and text are not read.  An empty
    table gives no rows.
    """
    ship_package(docs.sparkSession)
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, {PIECES}"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << TASK_SHIFT
        words, fit = encoder(WordEncoder, tokenizer_path), BestFit(capacity, open_bins)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, text):
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            rows = []
            for k, ids in zip(keys, words.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    number, offset = fit.place(len(part) // 4)
                    rows.append((k, piece, at // 4, len(part) // 4, part, zlib.crc32(part), first + number, offset))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(key, text).mapInArrow(run, ddl)
