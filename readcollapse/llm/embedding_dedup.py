"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised, x = s * q + e with q from -127 to 127.  For two of them
<x, y> = s_x s_y <q_x, q_y> + <e_x, y> + <s_x q_x, e_y>, so the quantised product is off by |e_x| + (1 + |e_x|) |e_y| at
most, and each |e| is known.  Tiles of quantised products (small integers, which single-precision products give exactly)
decide which pairs may reach the threshold; only those are computed again in double precision.

Equal vectors are one class.  Classes are dealt to cells by their nearest pivot and cells are cut into blocks; a pair of
blocks is compared in one task unless the distances of their cells to some pivot differ by more than near vectors can.
A task sends back a count for each class and a spanning forest of its links, never the links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
so do vectors of different lengths; repeated rows count as further vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, small_batches
from ..operators.components import components
from .vectors import BLOCK, celled, matrix, nonzero, pivots, usable

COSINE = 0.95
TILE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), s and an upper bound of |e| for every row of x (of length 1)."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None])
    return q.astype(np.int8), s, np.linalg.norm(x - q * s[:, None], axis=1) + 1e-12


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exactly: sums of 1024 products stay below 2**24."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= 1024 else np.float64)
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest component, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Side:
    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x = unit(x)
        self.q, self.s, self.e = quantise(self.x)
        self.weight = weight


def tile(a: Side, i: slice, b: Side, j: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns (within the tile) of pairs with a cosine of least or more."""
    near = product(a.q[i], b.q[j])
    near *= a.s[i, None].astype(np.float32)
    near *= b.s[None, j].astype(np.float32)
    # Single-precision scaling is off by less than 1e-6 of values up to about 1.
    need = (least - 2e-6 - a.e[i])[:, None] - ((1 + a.e[i].max(initial=0)) * b.e[j])[None]
    rows, cols = np.nonzero(near >= need.astype(np.float32))
    if not len(rows):
        return rows, cols
    if len(rows) > 8 * TILE:
        r, rr = np.unique(rows, return_inverse=True)
        c, cc = np.unique(cols, return_inverse=True)
        exact = (a.x[i][r] @ b.x[j][c].T)[rr, cc]
    else:
        exact = np.einsum("ij,ij->i", a.x[i][rows], b.x[j][cols])
    good = exact >= least
    return rows[good], cols[good]


def hook(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the trees of u[k] and v[k] for all k; roots are the smallest places."""
    while True:
        ru, rv = root[u], root[v]
        on = ru != rv
        if not on.any():
            return root
        u, v = u[on], v[on]
        np.minimum.at(root, np.maximum(ru[on], rv[on]), np.minimum(ru[on], rv[on]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        # One block against itself has side 0 only.
        order = np.argsort(side, kind="stable")
        group, side = group.take(pa.array(order)), side[order]
        dim = group.column("dim")[0].as_py()
        rep = group.column("rep").to_numpy()
        n = int((side == 0).sum())
        whole = Side(matrix(group.column("raw").combine_chunks(), dim), group.column("copies").to_numpy())
        one = n == len(side)
        count, root = np.zeros(len(side), np.int64), np.arange(len(side))
        for i in range(0, n, TILE):
            a = slice(i, min(i + TILE, n))
            for j in range(i if one else n, len(side), TILE):
                b = slice(j, min(j + TILE, len(side)))
                rows, cols = tile(whole, a, whole, b, least)
                rows, cols = rows + i, cols + j
                if one and i == j:
                    rows, cols = rows[rows < cols], cols[rows < cols]
                if len(rows):
                    count += np.bincount(rows, whole.weight[cols], len(side)).astype(np.int64) + np.bincount(cols, whole.weight[rows], len(side)).astype(np.int64)
                    root = hook(root, rows, cols)
        keep = np.flatnonzero(count)
        return pa.table({"rep": pa.array(rep[keep], pa.int64()), "root": pa.array(rep[root[keep]], pa.int64()), "links": pa.array(count[keep], pa.int64())})

    return run


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v: raw vectors scaled to length 1, as unit() does."""
    for batch in batches:
        v = batch.column("raw")
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat):
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), begin), size)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, begin)), size)
        offsets = pa.array(np.append(begin, len(flat)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), v, pa.ListArray.from_arrays(offsets, pa.array(flat))], ["rep", "copies", "raw", "v"])


def _ranges(centers: dict[int, np.ndarray]):
    """For each cell of a batch the smallest and largest distance to every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            out = {k: [] for k in ("dim", "cell", "pivot", "low", "high")}
            for dim in np.unique(dims):
                p = centers.get(int(dim))
                for cell in np.unique(cells[dims == dim]) if p is not None else ():
                    x = matrix(batch.column("v").filter(pa.array((dims == dim) & (cells == cell))), int(dim))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    d = np.sqrt(np.maximum(2 - 2 * x @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T, 0))
                    out["dim"] += [int(dim)] * len(p)
                    out["cell"] += [int(cell)] * len(p)
                    out["pivot"] += range(len(p))
                    out["low"] += d.min(axis=0).tolist()
                    out["high"] += d.max(axis=0).tolist()
            yield pa.RecordBatch.from_pydict({"dim": pa.array(out["dim"], pa.int32()), "cell": pa.array(out["cell"], pa.int32()), "pivot": pa.array(out["pivot"], pa.int32()), "low": pa.array(out["low"], pa.float64()), "high": pa.array(out["high"], pa.float64())})

    return run


def link(rows: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    small_batches(spark)
    # Vectors move as they are, in their own precision, and are scaled where they are used.
    everyone = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("raw"), F.col(vector).cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & usable(F.col("v")) & nonzero(F.col("v"))
    stored = checkpoint(everyone.filter(good).select("vec_id", "raw", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")))
    classes = checkpoint(stored.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")))
    members = stored.select("vec_id", "h1", "h2")
    count = classes.count()
    # Lengths do not matter to the cosine: cells are made of scaled vectors.
    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("rep", "raw")}
    scaled = checkpoint(map_arrow(classes.select("rep", "copies", "raw"), _scaled, f"rep {kinds['rep']}, copies long, raw {kinds['raw']}, v array<double>"))
    centers = pivots(scaled.select(F.col("rep").alias("vec_id"), "v"), count)
    kept = checkpoint(celled(scaled, centers))
    per = {(r["dim"], r["cell"]): r["n"] for r in kept.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = dict(centers)
    low: dict = {}
    for r in map_arrow(kept.select("dim", "cell", "v"), _ranges(held), "dim int, cell int, pivot int, low double, high double").groupBy("dim", "cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low.setdefault((r["dim"], r["cell"]), {})[r["pivot"]] = (r["low"], r["high"])
    reach = np.sqrt(2 - 2 * least) + 1e-6
    near = []
    for dim in {d for d, _ in per}:
        names = [c for d, c in per if d == dim]
        bounds = np.array([[low.get((dim, c), {}).get(p, (0.0, 2.0)) for p in range(len(held.get(dim, ())))] for c in names]).reshape(len(names), -1, 2)
        for i, a in enumerate(names):
            gap = np.maximum(bounds[i, :, 0] - bounds[:, :, 1], bounds[:, :, 0] - bounds[i, :, 1])
            near += [(dim, a, names[j], -(-per[dim, a] // BLOCK), -(-per[dim, names[j]] // BLOCK)) for j in np.flatnonzero(gap.max(axis=1, initial=0) <= reach).tolist()]
    schema = "dim int, cell int, other int, own_blocks int, blocks int"
    cells = F.broadcast(spark.createDataFrame(near, schema))  # PIVOTS**2 rows a dimension at most
    dealt = kept.join(cells, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own_blocks")).cast("int"))
    dealt = dealt.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("block").alias("b")), F.struct(F.col("other").alias("c"), F.col("their").alias("b"))
    dealt = dealt.select("dim", F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y"), (mine > theirs).cast("int").alias("side"), "rep", "copies", "raw")
    found = checkpoint(dealt.groupBy("dim", "x", "y").applyInArrow(_compare(least), "rep long, root long, links long"))
    labels = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    named = checkpoint(named.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = members.join(named, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))).select("vec_id", "n_links", "component_id")
    rest = everyone.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

