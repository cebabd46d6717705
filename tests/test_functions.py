import math
import random

import pytest
from pyspark.sql import functions as F

from readcollapse.functions.distance import within_distance
from readcollapse.functions.quality import ERROR_RATES, average_error_rate, average_error_rate_arrow, passes, quality_filter
from readcollapse.functions.records import are_mates, numbered, zipped
from readcollapse.functions.slices import checked_key, key, quality_key, slice_text

def substitutions(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("metric", "distance"), [("hamming", substitutions), ("levenshtein", edits)])
def test_within_distance(spark, metric, distance):
    rng = random.Random(5)
    words = ["", "T"] + ["".join(rng.choice("GTN") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    words += [w[:k] + "C" + w[k + rng.randint(0, 1) :] for w in words[2:30] for k in [rng.randint(0, len(w))]]
    rows = spark.createDataFrame([(rng.choice(words), rng.choice(words)) for _ in range(1500)] + [(w, w) for w in words], "a string, b string")
    for most in range(5):
        for r in rows.select("a", "b", within_distance(F.col("a"), F.col("b"), most, metric).alias("got")).collect():
            apart = distance(r["a"], r["b"])
            assert r["got"] == (apart is not None and apart <= most), r


def test_bad_distance():
    with pytest.raises(ValueError):
        within_distance(None, None, -1)


def test_slices_follow_python(spark):
    texts = ["", "a", "ab", "abc", "abcdefghij", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bounds, rng = [None, 0, 1, 3, 9, 12, -1, -3, -10, -12], random.Random(1)
    parts = [slice(rng.choice(bounds), rng.choice(bounds), rng.choice([None, 1, 3, -1, -2])) for _ in range(120)]
    for r in rows.select("t", *(slice_text(F.col("t"), p).alias(f"s{i}") for i, p in enumerate(parts))).collect():
        for i, p in enumerate(parts):
            assert r[f"s{i}"] == (None if r["t"] is None else r["t"][p]), (r["t"], p)


def test_keys(spark):
    row = spark.createDataFrame([("ACGT", "TTGA")], "a string, b string")
    assert row.select(key([F.col("a"), F.col("b")], [slice(3), slice(2, None)])).first()[0] == "ACGGA"
    # A missing quality goes before slices are paired.
    rows = spark.createDataFrame([(None, "abcdef"), ("uvw", "abcdef"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(quality_key([F.col("a"), F.col("b")], [slice(2), slice(3, 5)])).collect()] == ["ab", "uvde", ""]
    with pytest.raises(Exception, match="ASCII"):
        spark.createDataFrame([("é",)], "a string").select(checked_key(F.col("a"))).collect()


def rates(spark, texts, offset=33, arrow=False):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    f = average_error_rate_arrow(offset)(F.col("q")) if arrow else average_error_rate(F.col("q"), offset)
    return [r[1] for r in rows.select("i", f).orderBy("i").collect()]


@pytest.mark.parametrize("arrow", [False, True])
def test_error_rates(spark, arrow):
    assert rates(spark, [chr(10) + chr(30)], 0, arrow) == [0.0505]
    assert rates(spark, [chr(43) + chr(63)], arrow=arrow) == [0.0505]
    rng = random.Random(2)
    texts = ["".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    want = []
    for t in texts:
        total = 0.0
        for c in t:
            total += ERROR_RATES[ord(c) - 33]
        want.append(total / len(t))
    assert rates(spark, texts, arrow=arrow) == want
    got = rates(spark, ["", None, "I"], arrow=arrow)
    assert math.isnan(got[0]) and (got[1] is None or math.isnan(got[1])) and got[2] == ERROR_RATES[40]


@pytest.mark.parametrize("code", [0, 10, 32, 127])
def test_bad_scores(spark, code):
    with pytest.raises(Exception, match="outside of valid phred range"):
        rates(spark, ["I" + chr(code)])


def test_bad_characters(spark):
    with pytest.raises(Exception, match="must be ASCII encoded"):
        rates(spark, [chr(128)])


def test_filter_keeps_equal_and_empty(spark):
    rows = spark.createDataFrame([("?",), ("",), (None,), ("5",)], "q string")
    assert [r[0] for r in rows.select(passes(F.col("q"), 0.001)).collect()] == [True, True, True, False]


def test_a_filter_computes_its_qualities_once(spark):
    """The condition is pushed to the scan with names replaced by what they stand for."""
    rows = spark.range(3).select(F.md5(F.col("id").cast("string")).alias("q")).withColumn("r", F.reverse("q"))
    made = quality_filter(rows, quality_key([F.col("q"), F.col("r")]), 0.9)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 4 and plan.count("Filter") == 1
    once_only = quality_filter(rows, F.col("q"), 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert once_only.count("md5(") <= 2
    assert made.count() == 3


def test_mates(spark):
    rows = spark.createDataFrame([("r1 x", "r2 y"), ("r/1", "r/2"), ("a1", "b1"), ("r", "r")], "a string, b string")
    assert [r[0] for r in rows.select(are_mates(F.array("a", "b"))).collect()] == [True, True, False, True]


def test_positional_zip(spark):
    a = numbered(spark.range(1000).repartition(7).select((999 - F.col("id")).alias("x")), "x")
    b = numbered(spark.range(500).select((F.col("id") * 2).alias("y")), "y")
    got = sorted(zipped(a, b).collect())
    assert [(r["rec_idx"], r["x"], r["y"]) for r in got] == [(i, i, 2 * i) for i in range(500)]


def test_numbering_makes_rows_once(spark):
    """Cutting rows into ranges looks at them twice, and they were made each time."""
    made = spark.sparkContext.accumulator(0)

    def back(i):
        made.add(1)
        return 999 - i

    rows = spark.range(0, 1000, 1, 7).select(F.udf(back, "long")("id").alias("x"), F.lit("a").alias("y"))
    got = numbered(rows, "x", keep=["y"])
    assert sorted(map(tuple, got.collect())) == [(i, "a") for i in range(1000)]
    assert made.value == 1000


def test_numbered_rows_lie_in_order(spark):
    rows = numbered(spark.range(1000).repartition(7).select((F.col("id") % 100).alias("x"), "id"), "x", "id", in_order=True)
    assert [tuple(r) for r in rows.collect()] == [(i, i // 10, i // 10 + i % 10 * 100) for i in range(1000)]
    assert numbered(rows.filter("false"), "x").count() == 0
