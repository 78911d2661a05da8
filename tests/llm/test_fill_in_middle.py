"""Fill-in-the-middle forms against a plain version, and back to the texts."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexilake.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, output int"


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\n\n", "a", " a", "a ", "é🙂 ñ\x0b\x0c x\x00y z", "<P> held", "a <S>b", "<M>", "<<S <", "S> M> P>", "<P <S <M x y z",
         "w " * 30_000, "x" * 100_000]


def test_rows_equal_the_plain_version_and_read_back(spark):
    rows = [(k, t, "clash", 1) for k in (None, 0, 1, 2, 3, -5, 2 ** 40) for t in TEXTS] * 2
    made = fim.restore(fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()

    def order(r):
        return tuple((x is not None, x) for x in r)

    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=order)
    assert got == sorted(((k, *plain_version(k, t)) for k, t, *_ in rows), key=order)
    assert sorted(r.restored for r in made) == sorted(t or "" for _, t, *_ in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<PSM> \n\té🙂\x0b", max_size=12), *[st.integers(0, 2 ** 32 - 1)] * 4), max_size=6))
def test_any_batch_reads_back(rows):
    texts = pa.array([r[0] for r in rows], pa.string())
    draws = [pa.array([r[i] for r in rows], pa.int64()).to_numpy(zero_copy_only=False) for i in range(1, 5)]
    made = fim.transform_batch(texts, draws, plain_percent=100)
    assert fim.restore_batch(made["output"], made["form"]).to_pylist() == [r[0] for r in rows]
    assert list(made["n"]) == [len(UNIT.findall(r[0])) for r in rows]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.restore(fim.fill_in_middle(empty)).count() == 0


@pytest.mark.parametrize("slice_at", [1, 3])
def test_slices_of_batches(slice_at):
    texts = pa.array(["a b c", None, " d e f ", "g"]).slice(slice_at)
    draws = [pa.array([7] * len(texts)).to_numpy()] * 4
    made = fim.transform_batch(texts, draws, plain_percent=100)
    assert fim.restore_batch(made["output"], made["form"]).to_pylist() == [t or "" for t in texts.to_pylist()]
