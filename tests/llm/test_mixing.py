import hashlib
import random
from fractions import Fraction

import pytest
from helpers import clashing, documents
from pyspark.sql import functions as F

from readcollapse.llm import mixing


def plain_targets(sizes):
    """Sizes by source (in order) to targets, by giving the excess away again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, done, free = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return done | {s: float(level * weight[s]) for s in free}
        for s in over:
            done[s] = float(2 * sizes[s])
            left -= 2 * sizes[s]
        free -= over


def highest_quotients(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda k: (Fraction(weights[k]) / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 5, 37, 400])
def test_apportionment(spark, seats):
    rng = random.Random(seats)
    weights = {i: rng.choice([0, 1, 2, 3, 10, 100, 997]) for i in range(30)}
    rows = spark.createDataFrame([(1, i, w, seats, sum(weights.values())) for i, w in weights.items()], "g int, i int, w long, seats long, total long")
    got = {r["i"]: r["q"] for r in mixing.apportion(rows, ["g"], [F.col("i")], "w", "seats", "total", "q").collect()}
    assert got == highest_quotients(weights, seats)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.choice([1, 5, 40, 900])), "en", rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(400)]
    rows += [(400, None, None, "a"), (401, "", None, None), (402, " \t\n ", "en", "only-empty"), (403, "long " * 30_000, "en", "b"), (404, "one two", "en", "tiny")]
    docs = clashing(documents(spark, rows))
    got = mixing.mix(docs, shard_docs=50).collect()
    again = mixing.mix(docs.repartition(5), shard_docs=50).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    sizes = {}
    for i in text:
        sizes[source[i]] = sizes.get(source[i], 0) + len((text[i] or "").split())
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len((text[r["doc_id"]] or "").split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 * 12 for s in sizes), (taken, want)


def test_repeat_does_what_mix_says(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)) + "\n", "en", "ab"[i % 2]) for i in range(30)] + [(90, None, "en", "a")]
    docs = clashing(documents(spark, rows))
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words, text = {}, {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r["text"] is None or text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert all(words.get(i, 0) == n for i, n in taken.items()) and 90 in words


def test_repeated_rows_and_ids_are_repeated_as_the_mix_says(spark):
    rows = [(7, " ".join(["same"] * 50), "en", "a")] * 40 + [(8, " ".join([f"t{k}"] * 50), "en", "a") for k in range(20)] + [(i, "x " * 900, "en", "b") for i in range(9, 12)]
    docs = documents(spark, rows)
    want, got = {}, {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    for r in mixing.repeat(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {i: n for i, n in want.items() if n} and 0 < want[7] <= 2 * 2000


def test_blocks_counted_one_by_one(spark):
    """Each source's blocks laid out on its rings, and each document's words counted."""
    rng = random.Random(5)
    docs = documents(spark, [(i, " ".join(["w"] * rng.choice([0, 3, 17, 200])), "en", rng.choice("abc")) for i in range(150)])
    rings = {}
    measured = mixing._measured(docs).collect()
    source = {r["doc_id"]: r["source"] for r in measured}
    sizes = {s: sum(r["size"] for r in measured if r["source"] == s) for s in "abc"}
    for r in measured:
        shard = mixing_hash(mixing.SEED + 1, r["doc_id"], r["tie"]) % -(-sum(x["source"] == r["source"] for x in measured) // 20)
        rings.setdefault((r["source"], shard), []).append((mixing_hash(mixing.SEED, r["doc_id"], r["tie"]), r["doc_id"], r["size"]))
    want_target = plain_targets(sizes)
    blocks = highest_quotients(dict(enumerate(want_target[s] for s in "abc")), round(sum(want_target.values()) / 16))
    taken = {}
    for k, s in enumerate("abc"):
        words = {shard: sum(x[2] for x in ring) for (name, shard), ring in rings.items() if name == s}
        quota = highest_quotients(words, blocks[k])
        for shard, n in words.items():
            order = [i for _, i, size in sorted(rings[s, shard]) for _ in range(size)]
            start = mixing_hash(mixing.SEED + 2, k + 1, shard) % max(1, -(-n // 16)) * 16
            for w in range(min(quota[shard] * 16, 2 * n)):
                i = order[(start + w) % n]
                taken[i] = taken.get(i, 0) + 1
    got = mixing.mix(docs, shard_docs=20).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: taken.get(i, 0) for i in source}


def mixing_hash(seed, *values):
    return int(hashlib.md5(":".join(map(str, [*values, seed])).encode()).hexdigest()[:15], 16)


def test_empty(spark):
    docs = documents(spark, [])
    assert mixing.mix(docs).count() == 0 and mixing.repeat(docs).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None, None)])).first()["taken"] == 0
