"""Vectors of a table as bytes, with those that take no part set aside."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.shared import map_rows


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, dim, vec, vec_hash) of vectors that are not null, zero or with null or non-finite components.

    ``vec`` holds little-endian doubles; equal vectors have equal hashes, minus zero being zero.
    """
    def make():
        def run(b: pa.RecordBatch) -> dict:
            ids, dims, vecs, hashes = [], [], [], []
            lists = b.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values
            null = values.is_null().to_numpy(zero_copy_only=False)
            data = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(data))])
            filled = np.concatenate([[0], np.cumsum(data != 0)])
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, (k, s, e) in enumerate(zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())):
                if valid[i] and bad[s] == bad[e] and filled[s] < filled[e]:
                    ids.append(k)
                    dims.append(e - s)
                    vecs.append(data[s:e].tobytes())
                    hashes.append(hashlib.blake2b(vecs[-1], digest_size=16).digest())
            return {"id": ids, "dim": dims, "vec": vecs, "vec_hash": hashes}

        return run

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return map_rows(rows, make, "id long, dim int, vec binary, vec_hash binary")


def matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that no length overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
