"""Usable vectors of an embedding table, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.arrow import flat_floats

NEWEST = ("updated_at", "created_at")


def newest_vectors(df: DataFrame, model: str, dimension: int) -> DataFrame:
    """(chunk_id, paper_id, vec) of the newest row of each chunk under ``model``.

    ``vec`` is binary: half floats where these hold every number exactly, else
    single floats. A chunk whose newest row is null, has another length, holds
    NaN or infinity, or only zeros is left out. Among rows of the same
    ``updated_at`` the one of the newest ``created_at``, then the largest vector
    counts. Rows with a null chunk_id are left out.
    """
    rows = df.filter((F.col("embedding_model") == model) & F.col("chunk_id").isNotNull()).select("chunk_id", "paper_id", *NEWEST, F.col("embedding").cast("array<float>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_floats(batch.column(4))
            length = np.diff(offsets)
            vecs: list[bytes | None] = [None] * batch.num_rows
            right = np.flatnonzero(length == dimension)
            if len(right):
                m = values[(offsets[right][:, None] + np.arange(dimension))].astype(np.float32)
                good = np.isfinite(m).all(1) & (m != 0).any(1)
                with np.errstate(over="ignore"):
                    half = m.astype(np.float16)
                exact = (half.astype(np.float32) == m).all(1)
                for k, r in enumerate(right.tolist()):
                    if good[k]:
                        vecs[r] = half[k].tobytes() if exact[k] else m[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(vecs, pa.binary())], names=["chunk_id", "paper_id", *NEWEST, "vec"])

    packed = rows.mapInArrow(pack, "chunk_id string, paper_id string, updated_at timestamp, created_at timestamp, vec binary")
    newest = packed.groupBy("chunk_id").agg(F.max(F.struct(*NEWEST, "vec", "paper_id")).alias("r"))
    return newest.select("chunk_id", F.col("r.paper_id").alias("paper_id"), F.col("r.vec").alias("vec")).filter(F.col("vec").isNotNull())


def unpack(vecs: list[bytes], dimension: int) -> np.ndarray:
    """Rows of float32 from packed vectors."""
    if all(len(v) == 2 * dimension for v in vecs):
        return np.frombuffer(b"".join(vecs), np.float16).reshape(-1, dimension).astype(np.float32)
    return np.stack([np.frombuffer(v, np.float16 if len(v) == 2 * dimension else np.float32).astype(np.float32) for v in vecs]) if vecs else np.empty((0, dimension), np.float32)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, in double precision."""
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
