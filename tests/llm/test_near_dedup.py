import random
from math import log

import numpy as np
import pyarrow as pa
from helpers import clashing, documents, prose

from readcollapse.llm import near_dedup as nd


def shingle_counts(text):
    w = (text or "").lower().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {g: grams.count(g) for g in set(grams)}


def weighted(texts):
    """Weighted Jaccard similarity of all pairs, from exact document frequencies."""
    bags = [shingle_counts(t) for t in texts]
    n = sum(bool(b) for b in bags)
    df = {}
    for b in bags:
        for g in b:
            df[g] = df.get(g, 0) + 1
    idf = {g: 1 - log(min(1, max(nd.DF_FLOOR, k / n))) for g, k in df.items()}
    weight = [{g: (1 + log(c)) * idf[g] for g, c in b.items()} for b in bags]

    def similarity(a, b):
        inter = sum(min(x, weight[b][g]) for g, x in weight[a].items() if g in weight[b])
        return inter / max(sum(weight[a].values()) + sum(weight[b].values()) - inter, 1e-30)

    return similarity


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.randint(1, 80))) for _ in range(30)]
    for _ in range(12):
        seed_text = prose(rng, 120)
        for _ in range(6):
            copy = list(seed_text)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    texts += [None, "", " \n", texts[3], texts[3] + "\n", texts[40].upper(), "a b c", "A  b\tc", "long word " * 20_000]
    return texts


def groups(texts, ids):
    similarity = weighted(texts)
    real = [k for k in range(len(texts)) if texts[k] and texts[k].split()]
    root = {k: k for k in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in real:
        for b in real:
            if a < b and similarity(a, b) >= 0.8:
                x, y = find(a), find(b)
                root[y] = x
    out = {}
    for k in range(len(texts)):
        out.setdefault(find(k), []).append(ids[k])
    return {i: min(g) for g in out.values() for i in g}


def test_link_against_all_pairs(spark):
    texts = corpus()
    ids = [1000 - k for k in range(len(texts))]
    docs = clashing(documents(spark, [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]))
    got = nd.link(docs.repartition(5)).collect()
    want = groups(texts, ids)
    assert len(got) == len(texts) and {r["doc_id"]: r["component_id"] for r in got} == want
    same = {}
    for i, t in zip(ids, texts, strict=True):
        same.setdefault(" ".join(t.lower().split()) if t and t.split() else i, []).append(i)
    classes = {i: min(g) for g in same.values() for i in g}
    assert {r["doc_id"]: r["class_id"] for r in got} == classes
    kept = nd.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_large_bands_take_blocks(spark, monkeypatch):
    """Texts that are alike in part fill bands; with the limits down, the rest goes through blocks and nothing changes."""
    monkeypatch.setattr(nd, "PAIRS", 8)
    monkeypatch.setattr(nd, "BLOCK", 7)
    rng = random.Random(5)
    common = prose(rng, 100)
    texts = []
    for k in range(60):
        copy = common + [f"own{k // 2}x{j}" for j in range(24)]
        copy[rng.randrange(100)] = f"edit{k}"
        texts.append(" ".join(copy))
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    assert {r["doc_id"]: r["component_id"] for r in nd.link(docs).collect()} == groups(texts, list(range(60)))


def test_odd_tables(spark):
    assert nd.link(documents(spark, [])).count() == 0 and nd.deduplicate(documents(spark, [])).count() == 0
    rows = [(None, "same words here", "en", "s"), (None, "same words here", "en", "s"), (4, "x y", None, None), (4, "x y", None, None), (9, "X y", None, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["kept"]) for r in nd.link(documents(spark, rows)).collect())
    assert [x[2] for x in got] == [True, True, False, True, True]
    assert sorted(str(r["doc_id"]) for r in nd.deduplicate(documents(spark, rows)).collect()) == ["4", "None", "None"]


def test_an_id_of_different_texts(spark):
    rng = random.Random(7)
    near = lambda words, k: " ".join([*words[:k], "edit", *words[k + 1 :]])
    rows, kept, ids = [], [], {}
    for k in range(0, 200, 10):
        a, b, c, d = (prose(rng, 120) for _ in range(4))
        # k + 2 holds a text near to k's, one of its own class, one near to k + 3's, and none; k + 4 holds two texts near to each other.
        mine = [(k, " ".join(a)), (k + 2, near(a, 60)), (k + 2, " ".join(b)), (k + 2, " ".join(c)), (k + 2, " ".join(c).upper()), (k + 2, None), (k + 3, near(c, 30)), (k + 4, " ".join(d)), (k + 4, near(d, 50))]
        rows += mine
        kept += [(k, mine[0][1]), (k + 2, mine[2][1]), (k + 2, mine[3][1]), (k + 2, "")]
        ids |= {mine[0]: k, mine[1]: k, mine[2]: k + 2, mine[3]: k + 2, mine[6]: k + 2, mine[7]: k + 4, mine[8]: k + 4}
    rows += [(None, rows[0][1])]
    docs = clashing(documents(spark, [(i, t, "en", "s") for i, t in rows])).repartition(5)
    got = sorted((r["doc_id"], (r["text"] or "").lower()) for r in nd.deduplicate(docs).collect() if r["doc_id"] is not None)
    fours = [x for x in got if x[0] % 10 == 4]
    assert [x for x in got if x not in fours] == sorted(kept) and [x[0] for x in fours] == list(range(4, 204, 10))
    links = nd.link(docs).collect()
    want = [(i, ids.get((i, t), ids.get((i, (t or "").lower()), i))) for i, t in rows]
    assert sorted(str((r["doc_id"], r["component_id"])) for r in links) == sorted(map(str, want))
    assert [(r["class_id"], r["component_id"], r["kept"]) for r in links if r["doc_id"] is None] == [(None, None, True)]


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(6)
    a = prose(rng, 400, 10**9)
    b = a[:330] + prose(rng, 70, 10**9)
    idf = np.ones(1 << nd.DF_BITS, np.float32)
    idf[::3] = 2.5
    shingle, weight, begin, _, _ = nd.weigh(pa.array([" ".join(a), " ".join(b)]), idf)
    codes = nd.samples(shingle, weight, begin, 2000)
    k, m = begin[1], begin[2]
    assert abs((codes[0] == codes[1]).mean() - nd._similarity(shingle[:k], weight[:k], shingle[k:m], weight[k:m])) < 0.04
