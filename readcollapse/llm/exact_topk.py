"""Exact top-k by inner product with cover trees of queries and data, searched together.

A cover tree's node has a centre (one of its points) and a covering radius; its children's centres lie more than its scale apart and
cover its points at that scale, which shrinks by the factor BASE from level to level.  For a node Q of queries and a node N of data no
product exceeds <q, n> + |q| r_N + |n| r_Q + r_Q r_N, so the pair goes if that is below the worst kth score of Q's queries.
Points that are nearly alone at the next scale (in a child of fewer than FEW) stay with their node and are compared together: a tree over
vectors that are all about equally far apart is flat, and its search compares all (as no ball of it could be pruned).

Data are dealt to cells by their nearest pivot, and cells are cut into blocks.  A block is a forest of cover trees of TREE points at most, which a
task builds once and searches for all queries that come to it.  Queries come as rows: first each to one block near to it, for a kth
score to prune with; then to every cell whose ball may hold a higher score, judged for each query by the same bound
before anything moves.  Only where there are more than QUERIES queries, they are dealt to several tasks a block.

Components x become floor(scale * x); scores are integers and exact (in doubles, so below 2**53).

Defined results: vectors that are null, empty or hold null or non-finite components, or have a null id, take no part; vectors
of other lengths than the query's are no candidates; an id's repeated rows count once, in queries (of different vectors one counts) and in
candidates (there with the best score); a query with fewer candidates than k returns all; ties go to the smaller id; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, small_batches
from .vectors import celled, matrix, pivots, usable

K = 5
SCALE = 256.0
#: How much a level's scale is smaller than the one above.
BASE = 1.5
#: Nodes of so many points are not divided, and children of fewer points than FEW stay with their node.
LEAF = 32
FEW = 8
#: Points of a tree (the distances between them are held), of a cell as it is aimed at, of a block, and queries of a task.
TREE = 1024
CELL = 1024
BLOCK = 8192
QUERIES = 16384


class Node:
    """center: a point; points: all points below; own: those that no child holds; longest: the largest norm of a point.

    places and radii are the children's centres and radii, norms their largest norms.
    """

    __slots__ = ("center", "radius", "points", "own", "children", "longest", "places", "radii", "norms")

    def __init__(self, center: int, radius: float, points: np.ndarray):
        self.center, self.radius, self.points, self.own, self.children = center, radius, points, points, []

    def settle(self, norm: np.ndarray) -> Node:
        self.longest = float(norm[self.points].max(initial=0))
        self.places = np.array([c.center for c in self.children], np.int64)
        self.radii = np.array([c.radius for c in self.children])
        self.norms = np.array([norm[c.points].max() for c in self.children])
        return self


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A cover tree of the rows of x (or of some), from the top down."""
    rows = np.arange(len(x)) if rows is None else rows
    y = x[rows]
    square = (y * y).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (y @ y.T), 0))
    top = Node(0, float(apart[0].max()), np.arange(len(rows)))
    todo = [top]
    while todo:
        node = todo.pop()
        if len(node.points) > LEAF and node.radius > 0:
            # Scales are powers of the base, so that levels agree all over the tree.
            scale = BASE ** (np.ceil(np.log(node.radius) / np.log(BASE)) - 1)
            while scale >= node.radius:
                scale /= BASE
            near, owner, centers = apart[node.center, node.points], np.zeros(len(node.points), np.int64), [node.center]
            while True:
                far = int(near.argmax())
                if near[far] <= scale:
                    break
                gap = apart[node.points[far], node.points]
                closer = gap < near
                near[closer], owner[closer] = gap[closer], len(centers)
                centers.append(int(node.points[far]))
            many = np.bincount(owner, minlength=len(centers))
            alone = many[owner] < FEW
            for c in np.flatnonzero(many >= FEW).tolist():
                mine = owner == c
                node.children.append(Node(centers[c], float(near[mine].max()), node.points[mine]))
            node.own = node.points[alone]
            todo += node.children
    todo, order = [top], []
    while todo:
        node = todo.pop()
        todo += node.children
        node.center, node.points, node.own = int(rows[node.center]), rows[node.points], rows[node.own]
        order.append(node)
    norm = np.zeros(len(x))
    norm[rows] = np.sqrt(square)
    for node in reversed(order):  # children are settled before their parents
        node.settle(norm)
    return top


def forest(x: np.ndarray) -> list[Node]:
    """Cover trees of TREE rows of x at most: more are halved along the line between two that are far apart."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= TREE:
            out.append(cover_tree(x, rows))
            continue
        far = x[rows[np.linalg.norm(x[rows] - x[rows[0]], axis=1).argmax()]]
        other = x[rows[np.linalg.norm(x[rows] - far, axis=1).argmax()]]
        order = rows[np.argsort(x[rows] @ (other - far), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


class Best:
    """The k best of every query: scores falling, ids rising where scores are equal."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def least(self, rows: np.ndarray) -> np.ndarray:
        """No score below this can enter a query's list."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def worst(self, rows: np.ndarray) -> float:
        return float(self.least(rows).min())

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        # An id's rows are one place before the kth score is taken.
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        if len(first) < len(ids):
            ids, scores = ids[order[first]], np.maximum.reduceat(scores[:, order], first, axis=1)
        least = self.least(rows)
        if scores.shape[1] > self.k:
            # What is below a list's kth of these alone cannot enter either.
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        rr = np.concatenate([r, np.repeat(np.arange(len(rows)), self.k)])
        ss = np.concatenate([scores[r, c], self.score[rows].ravel()])
        ii = np.concatenate([ids[c], self.id[rows].ravel()])
        order = np.lexsort((-ss, ii, rr))
        rr, ss, ii = rr[order], ss[order], ii[order]
        new = np.ones(len(rr), bool)
        new[1:] = (rr[1:] != rr[:-1]) | (ii[1:] != ii[:-1])
        new |= ss == -np.inf
        rr, ss, ii = rr[new], ss[new], ii[new]
        order = np.lexsort((ii, -ss, rr))
        rr, ss, ii = rr[order], ss[order], ii[order]
        place = np.arange(len(rr)) - np.searchsorted(rr, rr)
        on = place < self.k
        self.score[rows[rr[on]], place[on]] = ss[on]
        self.id[rows[rr[on]], place[on]] = ii[on]


def search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, floor: np.ndarray, counted: list[int] | None = None) -> Best:
    """The k best rows of x for every row of q, but for scores below floor.  counted gets how many products were computed, those with centres included.

    Pairs of nodes are visited by falling bounds, and go if no query of the one can want a point of the other.  Of the rest the node of
    the larger radius is divided.  The queries of a leaf are then held against a data node's children each by its own bound
    and kth score, and what remains of the children that are leaves is compared by matrix products.
    """
    best, products = Best(len(q), k, floor), 0
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)

    def bounds(a: np.ndarray, ra, la, b: np.ndarray, rb, lb) -> np.ndarray:
        """The most that products of balls of queries around q[a] and balls of data around x[b] can be: by the norms, and by the distances.

        r are radii, l the largest norms.  <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2, and no two points are nearer than the balls are.
        """
        nonlocal products
        products += len(a) * len(b)
        inner, qn, xn = q[a] @ x[b].T, q_norm[a][:, None], x_norm[b][None]
        by_norm = inner + qn * rb + xn * ra + ra * rb
        gap = np.sqrt(np.maximum(qn * qn + xn * xn - 2 * inner, 0)) - ra - rb
        by_distance = (la * la + lb * lb - np.maximum(gap, 0) ** 2) / 2
        return np.minimum(by_norm, by_distance) * (1 + 1e-12) + 1e-6

    def one(a: Node, b: Node) -> float:
        return float(bounds(np.array([a.center]), a.radius, a.longest, np.array([b.center]), b.radius, b.longest)[0, 0])

    def compare(rows: np.ndarray, points: np.ndarray) -> None:
        nonlocal products
        products += len(rows) * len(points)
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            scores = q[part] @ x[points].T
            scores[q_id[part, None] == x_id[None, points]] = -np.inf
            best.add(part, x_id[points], scores)

    def leaf(a: Node, rows: np.ndarray) -> Node:
        return Node(a.center, a.radius, rows).settle(q_norm)

    todo = sorted(((one(a, b), a, b) for a in forest(q) for b in forest(x)), key=lambda p: p[0])
    while todo:
        most, a, b = todo.pop()
        if most < best.worst(a.points):
            continue
        if a.children and (not b.children or a.radius > b.radius):
            parts = [*a.children, *([leaf(a, a.own)] if len(a.own) else [])]
            todo += sorted(((one(c, b), c, b) for c in parts), key=lambda p: p[0])
            continue
        if a.children:
            most = bounds(np.array([a.center]), a.radius, a.longest, b.places, b.radii, b.norms)[0].tolist()
            todo += [(one(a, rest), a, rest)] if len((rest := Node(b.center, b.radius, b.own).settle(x_norm)).points) else []
            todo += sorted(((m, a, c) for m, c in zip(most, b.children, strict=True)), key=lambda p: p[0])
            continue
        rows = a.points
        if len(b.own):
            compare(rows, b.own)
        if not b.children:
            continue
        most = bounds(rows, 0.0, q_norm[rows][:, None], b.places, b.radii, b.norms)
        alive = most >= best.least(rows)[:, None]
        near, inner = [], []
        for i in np.flatnonzero(alive.any(axis=0)).tolist():
            child = b.children[i]
            if child.children:
                own = np.flatnonzero(alive[:, i])
                inner.append((float(most[own, i].max()), leaf(a, rows[own]), child))
            elif alive[:, i].mean() > 0.5:
                near.append(child.points)
            else:
                compare(rows[alive[:, i]], child.points)
        if near:
            compare(rows, np.concatenate(near))
        todo += sorted(inner, key=lambda p: p[0])
    if counted is not None:
        counted.append(products)
    return best


def _searched(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and data.num_rows:
            dim = queries.column("dim")[0].as_py()
            q, x = (matrix(t.column("v").combine_chunks(), dim) for t in (queries, data))
            q_id, x_id = queries.column("query_id").to_numpy(), data.column("vec_id").to_numpy()
            best = search(q, q_id, x, x_id, k, queries.column("floor").to_numpy().astype(float))
            at, place = np.nonzero(best.score > -np.inf)
            out = {"query_id": q_id[at], "vec_id": best.id[at, place], "score": best.score[at, place].astype(np.int64)}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def _balls(centers: dict[int, np.ndarray]):
    """Radius of every cell of a batch around its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            rows = []
            for dim in np.unique(dims):
                for cell in np.unique(cells[dims == dim]):
                    x = matrix(batch.column("v").filter(pa.array((dims == dim) & (cells == cell))), int(dim))
                    rows.append({"dim": int(dim), "cell": int(cell), "radius": float(np.linalg.norm(x - centers[int(dim)][cell], axis=1).max())})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("radius", pa.float64())]))

    return run


def _sizes(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, float]]:
    """Number of rows and radius of each cell: PIVOTS rows for each length that occurs."""
    count = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    ball = map_arrow(rows.select("dim", "cell", "v"), _balls(centers), "dim int, cell int, radius double").groupBy("dim", "cell").agg(F.max("radius").alias("radius"))
    return {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in count.join(F.broadcast(ball), ["dim", "cell"]).collect()}


def _routed(cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """For queries (query_id, v, floor) the cells of their length to search: the one whose ball reaches highest, or all that reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                v, floor = part.column("v"), part.column("floor").to_numpy()
                dims, at, cell = v.value_lengths().to_numpy(zero_copy_only=False), [], []
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    names, p, radius = cells[dim]
                    q = matrix(v.take(pa.array(rows)), dim)
                    inner = q @ p.T
                    most = (inner + np.linalg.norm(q, axis=1)[:, None] * radius) * (1 + 1e-12) + 1e-6
                    found = (rows, (2 * inner - (p * p).sum(axis=1)).argmax(axis=1)) if first else np.nonzero(most >= floor[rows, None])
                    at.append(found[0] if first else rows[found[0]])
                    cell.append(names[found[1]])
                at, cell = np.concatenate(at), np.concatenate(cell)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("v"), taken.column("floor"), pa.array(dims[at], pa.int32()), pa.array(cell, pa.int32())], ["query_id", "v", "floor", "dim", "cell"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query row among all other rows."""
    spark = rows.sparkSession
    small_batches(spark)
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    good = rows.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = checkpoint(good)
    count = good.count()
    centers = pivots(good.select("vec_id", "v"), count, CELL)
    data = checkpoint(celled(good, centers))
    # Pivots come from a sample: a length that is not in it has one cell, -1, around zero.
    held = {r["dim"]: np.zeros((1, r["dim"])) for r in data.select("dim").distinct().collect()} | dict(centers)
    asked = data.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = checkpoint(asked.select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor")), count)
    chunks = max(1, -(-asked.count() // QUERIES))
    sizes = _sizes(data.select("dim", "cell", "v"), held)
    cells = {}
    for d in held:
        names = [c for dim, c in sizes if dim == d]
        cells[d] = np.array(names), held[d][names], np.array([sizes[d, c][1] for c in names])
    blocks = [(d, c, -(-n // BLOCK)) for (d, c), (n, _) in sizes.items()]
    blocks = F.broadcast(spark.createDataFrame(blocks, "_dim int, _cell int, blocks int"))  # PIVOTS rows for each length that occurs
    placed = lambda df: df.join(blocks, (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")))
    by = ["dim", "cell", "block", "chunk"]
    place = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    blocked = placed(data).withColumn("block", place("vec_id", F.col("blocks")))

    def searched(queries: DataFrame, first: bool, parts: int) -> DataFrame:
        routed = placed(map_arrow(queries, _routed(cells, first), "query_id long, v array<double>, floor double, dim int, cell int"))
        block = place("query_id", F.col("blocks")) if first else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        q = routed.withColumn("block", block).withColumn("chunk", place("query_id", F.lit(parts)))
        d = blocked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        q = q.select(*(F.col(c).alias(c) for c in [*by, "query_id", "v", "floor"]))
        d = d.select(*(F.col(c).alias(c) for c in [*by, "vec_id", "v"]))
        return q.groupBy(*by).cogroup(d.groupBy(*by)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")

    near = searched(asked, True, chunks)
    kth = checkpoint(near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("_floor")), count)
    asked = checkpoint(asked.join(kth.withColumnRenamed("query_id", "_id"), F.col("query_id") == F.col("_id"), "left").select("query_id", "v", F.coalesce("_floor", "floor").alias("floor")), count)
    found = searched(asked, False, chunks)
    # A task returns k rows a query at most, so a query has k rows for each block at most; an id's rows may lie in several cells.
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
