"""What the two vector operators share: valid rows, pivots, cells and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Rows of a block, and the most pivots: what comes to the driver is bounded by 16 * PIVOTS sampled vectors and PIVOTS**2 figures.
BLOCK = 8192
PIVOTS = 256
SEED = 36


def usable(vector) -> F.Column:
    """True for a vector that is not null or empty and holds finite components only."""
    v = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def nonzero(vector) -> F.Column:
    return F.coalesce(F.exists(vector.cast("array<double>"), lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length dim."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pivots(rows: DataFrame, count: int, per: int = BLOCK) -> list[tuple[int, np.ndarray]]:
    """For each dimension a matrix of pivots, one for `per` rows but PIVOTS at most: spread out (farthest first) over 16 times as many rows
    (those with the smallest seeded hash)."""
    want = max(1, min(PIVOTS, -(-count // per)))
    near = rows.withColumn("_h", F.xxhash64("v", F.lit(SEED))).orderBy("_h", "vec_id").limit(16 * max(want, 48)).collect()
    out: dict[int, list] = {}
    for r in near:
        out.setdefault(len(r["v"]), []).append(r["v"])
    for dim, found in out.items():
        x = np.array(found)
        chosen = [0]
        gap = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < want and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[dim] = x[chosen]
    return sorted(out.items())


def celled(rows: DataFrame, centers: list[tuple[int, np.ndarray]]) -> DataFrame:
    """rows (vec_id, v and others) with `dim`, `cell`: the place of the nearest pivot of that dimension, -1 if it has none."""
    held = rows.sparkSession.sparkContext.broadcast(dict(centers))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            cell = np.full(len(dims), -1)
            for dim in np.unique(dims):
                if int(dim) in held.value:
                    at = np.flatnonzero(dims == dim)
                    x, p = matrix(batch.column("v").take(pa.array(at)), int(dim)), held.value[int(dim)]
                    cell[at] = ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(cell, pa.int32())], [*names, "dim", "cell"])

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(rows, run, f"{fields}, dim int, cell int")
