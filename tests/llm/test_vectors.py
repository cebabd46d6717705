import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readcollapse.llm import embedding_dedup, exact_topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def odd(dim):
    return [(9000, None), (9050, []), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [None] + [1.0] * (dim - 1)), (9100, [float("inf")] + [1.0] * (dim - 1)), (9004, [1.0, 0.0]), (9150, [2.0, 0.0])]


def fixture(seed=1, dim=12, groups=25):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        rows += [base + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.25]) for _ in range(8)]
    rows += [rows[0]] * 30 + [rows[9] * 3.0] + [-rows[5]]
    random.Random(seed).shuffle(rows)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [8192, 16])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    rows = fixture() + odd(12) + [(None, [1.0] * 12)]
    got = {r["vec_id"]: r for r in embedding_dedup.link(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for i, x in good:
        for j, y in good:
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i].add(j)
    for i, r in got.items():
        assert r["n_links"] == len(links[i])
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        assert r["component_id"] == (None if i is None else min(seen)) and r["kept"] == (i is None or i == min(seen))
    assert embedding_dedup.link(table(spark, [])).count() == 0


def test_quantised_products_stay_within_their_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 70)) * rng.lognormal(size=(200, 70))
    side = embedding_dedup.Side(x, np.ones(200, int))
    near = embedding_dedup.product(side.q, side.q) * side.s[:, None] * side.s[None]
    assert (np.abs(near - side.x @ side.x.T) <= side.e[:, None] + (1 + side.e[:, None]) * side.e[None] + 1e-5).all()
    whole = side.q.astype(np.int64)
    assert (embedding_dedup.product(side.q, side.q) == whole @ whole.T).all()


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "LEAF", 4)
    monkeypatch.setattr(exact_topk, "FEW", 2)
    if block == 16:
        monkeypatch.setattr(exact_topk, "CELL", 16)
        monkeypatch.setattr(exact_topk, "TREE", 16)
        monkeypatch.setattr(exact_topk, "QUERIES", 5)
    rows = fixture(3) + odd(12)
    rows.append(rows[0])
    got = {}
    for r in exact_topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for i, x in good.items():
        if i % 10 == 0:
            best = sorted((-int(x @ y), j) for j, y in good.items() if j != i and len(x) == len(y))[:5]
            if best:
                want[i] = [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == want and any(len(v) < 5 for v in got.values())
    assert exact_topk.top_k(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert exact_topk.top_k(table(spark, rows), F.col("vec_id") == -1).count() == 0


def test_top_k_of_lengths_outside_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(8000)] + [(9000 + i, [1.0 + i, 2.0 - i]) for i in range(4)] + [(9500, [1.0])]
    whole = spark.createDataFrame([(i, np.floor(256 * np.array(v)).tolist()) for i, v in rows], "vec_id long, v array<double>")
    monkeypatch.setattr(vectors, "PIVOTS", 48)
    assert [d for d, _ in vectors.pivots(whole, len(rows), 256)] == [3]
    got = exact_topk.top_k(table(spark, rows), F.col("vec_id").isin(0, 9000, 9002, 9500)).orderBy("query_id", "rank").collect()
    want = []
    for i in (0, 9000, 9002):
        x = dict(rows)[i]
        best = sorted((-int(np.floor(256 * np.array(x)) @ np.floor(256 * np.array(y))), j) for j, y in rows if j != i and len(y) == len(x))[:5]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert [tuple(r) for r in got] == want and len(want) == 11


@pytest.mark.parametrize("copies", [2, 6])
def test_repeated_ids_take_one_place(spark, copies):
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(30, 8)))
    best = exact_topk.search(x[:3], np.arange(3), np.repeat(x, copies, axis=0), np.repeat(np.arange(30), copies), 5, np.full(3, -np.inf))
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)] * copies
    got = exact_topk.top_k(table(spark, rows), F.col("vec_id") < 3).orderBy("query_id", "rank").collect()
    want = []
    for i in range(3):
        top = sorted((-int(x[i] @ y), j) for j, y in enumerate(x) if j != i)[:5]
        assert best.id[i].tolist() == [j for _, j in top] and best.score[i].tolist() == [-s for s, _ in top]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(top, 1)]
    assert [tuple(r) for r in got] == want


def test_an_id_of_different_vectors_is_one_candidate(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [float(j), 1.0]) for j in range(-20, 21)] + [(i, [i / 8.0, 0.0]) for i in range(2, 8)]
    got = exact_topk.top_k(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 20 << 16)] + [(i, i << 13) for i in (7, 6, 5, 4)]


def test_top_k_of_many_rare_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(12_000)] + [(20_000 + 2 * d + j, rng.normal(size=d).tolist()) for d in range(5, 35) for j in (0, 1)]
    got = exact_topk.top_k(table(spark, rows), F.col("vec_id") >= 20_000).collect()
    value = {i: np.floor(256 * np.array(v)) for i, v in rows[12_000:]}
    assert sorted(tuple(r) for r in got) == sorted((i, 1, i ^ 1, int(v @ value[i ^ 1])) for i, v in value.items())


@pytest.mark.parametrize(("dim", "groups", "noise", "share"), [(3, 20, 0.01, 0.1), (64, 200, 0.02, 0.5)])
def test_fewer_products_than_all_where_vectors_have_clusters(dim, groups, noise, share):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(groups, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = np.floor(256 * (np.repeat(centers, 6000 // groups, axis=0) + noise * rng.normal(size=(6000 // groups * groups, dim))))
    ids = rng.permutation(len(x))
    asked, counted = ids % 50 == 0, []
    best = exact_topk.search(x[asked], ids[asked], x, ids, 5, np.full(asked.sum(), -np.inf), counted)
    scores = x[asked] @ x.T
    scores[ids[asked][:, None] == ids[None]] = -np.inf
    for k, i in enumerate(np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :5]):
        assert best.id[k].tolist() == ids[i].tolist() and best.score[k].tolist() == scores[k, i].tolist()
    assert counted[0] < share * scores.size


@pytest.mark.parametrize(("few", "size"), [(2, 400), (8, 400), (8, 3000)])
def test_cover_tree(monkeypatch, few, size):
    monkeypatch.setattr(exact_topk, "FEW", few)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(size, 3)) * 0.01 + c for c in rng.normal(size=(6, 3)) * 10])[: 6 * size]
    norm = np.linalg.norm(x, axis=1)
    todo = exact_topk.forest(x)
    assert sorted(np.concatenate([t.points for t in todo])) == list(range(len(x))) and all(len(t.points) <= exact_topk.TREE for t in todo)
    nodes = 0
    while todo:
        node = todo.pop()
        nodes += 1
        gap = np.linalg.norm(x[node.points] - x[node.center], axis=1)
        assert gap.max() <= node.radius + 1e-9 and node.longest == pytest.approx(norm[node.points].max())
        if node.children:
            assert sorted(np.concatenate([node.own, *(c.points for c in node.children)])) == sorted(node.points)
            scale = exact_topk.BASE ** (np.ceil(np.log(node.radius) / np.log(exact_topk.BASE)) - 1)
            centers = x[[c.center for c in node.children]]
            apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)[~np.eye(len(centers), dtype=bool)]
            assert all(c.radius <= scale + 1e-6 and len(c.points) >= few for c in node.children) and (not len(apart) or apart.min() > scale - 1e-6)
            todo += node.children
    assert nodes > 6
