import random

import pytest
from pyspark.sql import functions as F

import readcollapse.operators.clusters as clusters_module
from readcollapse.functions.quality import passes, passes_arrow
from readcollapse.operators import combine
from readcollapse.operators.clusters import clusters, count_keys, custom, first_records, survivors
from readcollapse.operators.components import components
from readcollapse.operators.pairs import contains, similarity_pairs
from readcollapse.operators.shape import check_alphabet, letters, memory, nodes, report, shape
from readcollapse.options import DedupOptions
from readcollapse.plans.pipeline import Deduplication


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


DISTANCE = {"hamming": hamming, "levenshtein": levenshtein}


def keyed(spark, counts):
    return spark.createDataFrame(list(counts.items()), "seq string, n long")


def plain(counts, most, metric, method):
    """One key at a time, as the definitions say."""
    left = sorted(((n, s) for s, n in counts.items()), reverse=True)
    out = []
    near = lambda a, b: DISTANCE[metric](a, b) <= most
    while left:
        top = left.pop(0)
        out.append(top[1])
        if method == "adjacency":
            left = [x for x in left if not near(top[1], x[1])]
            continue
        chain = [top]
        for t in chain:
            more = [x for x in left if 2 * x[0] - 1 <= t[0] and near(t[1], x[1])]
            chain += more
            left = [x for x in left if x not in more]
    return sorted(out)


@pytest.mark.parametrize("metric", ["hamming", "levenshtein"])
@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_pairs_and_contains(spark, metric, most):
    rng = random.Random(most)
    words = list({"".join(rng.choice("ACG") for _ in range(rng.randint(0, 7))) for _ in range(70)})
    got = similarity_pairs(keyed(spark, {w: i + 1 for i, w in enumerate(words)}), most, metric).collect()
    want = {(a, b) for a in words for b in words if a < b and DISTANCE[metric](a, b) <= most}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(words[r["an"] - 1] == r["a"] and words[r["bn"] - 1] == r["b"] for r in got)
    probes = [*words[:20], "TTTT", "", "ACGACGA"]
    stored = words[20:50]
    found = contains(keyed(spark, dict.fromkeys(stored, 1)), spark.createDataFrame([(p,) for p in probes], "seq string"), most, metric).collect()
    assert len(found) == len(probes) and all(r["found"] == any(DISTANCE[metric](r["seq"], s) <= most for s in stored) for r in found)


MEMBERSHIP = [
    (["GATTACA"], "hamming", [("GATTACA", 0, True), ("AATTACA", 1, True), ("GATTACC", 1, True), ("GACCACA", 2, True), ("GACCACA", 1, False), ("GATTACC", 0, False)]),
    (["GATTACA"], "levenshtein", [("GATTACA", 0, True), ("GACCACA", 1, False), ("GATTAA", 1, True), ("GATTAC", 1, True), ("ATTAC", 2, True)]),
    (["GATTACA", "GATTA"], "levenshtein", [("GATTA", 0, True), ("GATTAC", 1, True), ("G", 4, True), ("GATTAT", 2, True), ("UU", 4, False), ("UU", 5, True), ("UUUUU", 3, False), ("ATTAC", 2, True)]),
    ([], "hamming", [("A", 0, False), ("A", 2, False)]),
]


@pytest.mark.parametrize(("stored", "metric", "cases"), MEMBERSHIP)
def test_membership(spark, stored, metric, cases):
    for text, most, want in cases:
        keys = spark.createDataFrame([(s, 1) for s in stored], "seq string, n long")
        assert contains(keys, spark.createDataFrame([(text,)], "seq string"), most, metric).first()["found"] == want, (text, most)


def test_clusters(spark):
    given = ["AAAA", "AAAA", "AAAC", "AAGC", "AGGC", "CCCG", "CCCG", "TTCA", "TTCC", "TTTA", "TTT", "TTC"]
    keys = count_keys(spark.createDataFrame([(x,) for x in given], "s string"), F.col("s"))
    for metric, want in (("hamming", [{"AAAA", "AAAC", "AAGC", "AGGC"}, {"CCCG"}, {"TTCA", "TTCC", "TTTA"}, {"TTT", "TTC"}]), ("levenshtein", [{"AAAA", "AAAC", "AAGC", "AGGC"}, {"CCCG"}, {"TTCA", "TTCC", "TTTA", "TTT", "TTC"}])):
        got = {}
        for r in clusters(keys, similarity_pairs(keys, 1, metric)).collect():
            assert r["n"] == given.count(r["seq"])
            got.setdefault(r["cluster_id"], set()).add(r["seq"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and all(k == min(v) for k, v in got.items())
    assert clusters(keys, similarity_pairs(keys, 0)).filter("seq = cluster_id").count() == 10


GIVEN = {"AAAGT": 3, "AAAAT": 10, "AACAA": 50, "AAAAA": 60, "CAAAA": 10, "CTAAA": 30}
CHAIN = {"GGGGGG": 100, "GGGTGG": 1, "GGGTTG": 1, "GGCTTG": 1, "GACTTG": 1, "AACTTG": 2}


@pytest.mark.parametrize(
    ("counts", "method", "want"),
    [
        (GIVEN, "highest_count", ["AAAAA"]),
        (GIVEN, "adjacency", ["AAAAA", "AAAGT", "CTAAA"]),
        (GIVEN, "directional", ["AAAAA", "AACAA", "CTAAA"]),
        (CHAIN, "directional", ["AACTTG", "GGGGGG"]),
        *(({"AAAA": 7, "AAAT": 1, "CAAA": 1}, m, ["AAAA"]) for m in ("highest_count", "adjacency", "directional")),
        *(({}, m, []) for m in ("highest_count", "adjacency", "directional")),
    ],
)
def test_dissections(spark, counts, method, want):
    keys = spark.createDataFrame(list(counts.items()), "seq string, n long")
    assert sorted(r["seq"] for r in survivors(keys, similarity_pairs(keys), method).collect()) == want


@pytest.mark.parametrize("metric", ["hamming", "levenshtein"])
@pytest.mark.parametrize("method", ["adjacency", "directional"])
def test_dissections_follow_the_plain_loop(spark, metric, method):
    rng = random.Random(7)
    for most in (1, 2):
        counts = {"".join(rng.choice("AC") for _ in range(rng.choice([6, 7]))): rng.choice([1, 1, 1, 2, 2, 3, 5, 9]) for _ in range(60)}
        keys = keyed(spark, counts)
        assert sorted(r["seq"] for r in survivors(keys, similarity_pairs(keys, most, metric), method).collect()) == plain(counts, most, metric, method)


def test_custom(spark):
    keys = keyed(spark, GIVEN)
    got = custom(clusters(keys, similarity_pairs(keys)), lambda f: f.sort_values("n").head(1)).collect()
    assert [r["seq"] for r in got] == ["AAAGT"]


def test_deleted_keys(spark):
    keys = keyed(spark, {"AA": 3, "AC": 1, "T": 2})
    gone = spark.createDataFrame([("AA",), ("GG",), ("T",), ("T",)], "seq string")
    assert [tuple(r) for r in clusters_module.delete_keys(keys, gone).collect()] == [("AC", 1)]
    assert contains(clusters_module.delete_keys(keys, gone), gone, 1).filter("found").count() == 1  # AA is within one of AC


@pytest.mark.parametrize("links", [1 << 20, 10])
def test_adjacency_settles_long_chains(spark, monkeypatch, links):
    """A chain of falling counts would take a round for every other key."""
    monkeypatch.setattr(clusters_module, "ROUNDS", 2)
    monkeypatch.setattr(clusters_module, "TASK_LINKS", links)
    chain = ["A" * k + "C" * (12 - k) for k in range(13)]
    counts = {w: 100 - k for k, w in enumerate(chain)} | {"G" * 9: 5, "G" * 8 + "T": 5, "T" * 30: 1}
    keys = keyed(spark, counts)
    got = sorted(r["seq"] for r in survivors(keys, similarity_pairs(keys, 1, "hamming"), "adjacency").collect())
    assert got == plain(counts, 1, "hamming", "adjacency") and len(got) == 9


def test_first_records_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 20 else f"k{i}", i % 7) for i in range(2000)] + [(5000, None, 0), (5001, "hot", 0), (5001, "hot", 0)]
    reads = spark.createDataFrame(rows, "i int, k string, _key int")
    kept = spark.createDataFrame([("hot",), ("k40",), ("absent",)], "seq string")
    got = first_records(reads, kept, F.col("k"), F.col("i"))
    assert got.columns == reads.columns and sorted(got.collect()) == [(1, "hot", 1), (40, "k40", 5)]
    tied = first_records(reads, kept, F.col("k"), F.lit(0)).collect()
    assert sorted(r["k"] for r in tied) == ["hot", "k40"]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in links:
        if a is not None:
            root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def tree(words, order):
    """Nodes of a tree built word by word: (layer, capacity, suffix)."""
    out = []

    def visit(prefix):
        mine = [w for w in words if w.startswith(prefix)]
        if len(mine) == 1:
            out.append((len(prefix), 0, len(mine[0]) - len(prefix)))
            return
        following = sorted({w[len(prefix)] for w in mine if len(w) > len(prefix)})
        out.append((len(prefix), 1 + max(order.index(x) for x in following), 0))
        for x in following:
            visit(prefix + x)

    if words:
        visit("")
    return sorted(out)


def test_shape(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ACGTNX") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    keys = keyed(spark, dict.fromkeys(words, 2))
    want = tree(words, "ACGTNX")
    assert sorted(tuple(r) for r in nodes(keys).collect()) == want
    got = memory(keys).first()
    assert got["total_bytes"] == sum(8 + 8 * c + s for _, c, s in want) and got["suffix_bytes"] == sum(s for _, _, s in want)
    assert shape(keys).agg(F.sum("nodes")).first()[0] == len(want)
    assert [r["letter"] for r in letters(keys, "ACGTN").orderBy("place").collect()] == list("ACGTNX")
    small = keyed(spark, {"AC": 3, "AG": 1, "T": 1})
    assert report(small).split("\n") == [
        "     depth    leaves    room 1    room 2    room 3    room 4     nodes",
        "         0         0         0         0         0         1         1",
        "         1         1         0         0         1         0         2",
        "         2         2         0         0         0         0         2",
        "       all         3         0         0         1         1         5",
        f"nodes: {96 / 1024**3:.2} GiB", f"suffixes: {0 / 1024**3:.2} GiB", f"nodes and suffixes: {96 / 1024**3:.2} GiB", "",
    ]
    with pytest.raises(ValueError, match="G was repeated"):
        letters(keys, "AGCG")
    with pytest.raises(ValueError, match="ASCII"):
        shape(keys, "Aé")
    empty = spark.createDataFrame([], "seq string, n long")
    assert memory(empty).first()["total_bytes"] == 0 and nodes(empty).count() == 0


def test_alphabet():
    assert check_alphabet("acd") == "acd"
    with pytest.raises(ValueError, match="c was repeated"):
        check_alphabet("abcc")
    with pytest.raises(ValueError):
        check_alphabet("é")


def test_output_makes_reads_once(spark):
    """Keys and first records come of one pass; reads were made for the keys, for the first places and for the rows at them."""
    made = spark.sparkContext.accumulator(0)

    def name(i):
        made.add(1)
        return f"{i:04d}"

    rows = spark.range(0, 600, 1, 3).select(F.udf(name)(F.col("id")).alias("name"), F.element_at(F.array(*map(F.lit, ["AAAA", "AAAC", "TTTT"])), (F.col("id") % 3 + 1).cast("int")).alias("s"), F.when(F.col("id") < 100, "####").otherwise("IIII").alias("q"))
    one = lambda method: Deduplication(rows, [F.col("s")], [F.col("q")], F.col("name"), DedupOptions(method=method))
    for method in ("adjacency", "directional"):
        made.value = 0
        job = one(method)
        assert sorted(map(tuple, job.output.collect())) == [("0001", "AAAC", "####"), ("0002", "TTTT", "####")] or method == "directional"
        assert made.value == 600 and job.observed.get == {"total": 600, "discarded": 100}
        # By way of the keys, asked for first, or of the reads kept, too.
        other, third = one(method), one(method)
        assert other.keys.count() == 3 and third.kept.count() == 500 and job.kept.count() == 500
        assert sorted(other.output.collect()) == sorted(job.output.collect()) == sorted(third.output.collect())


def test_first_records_pass_over_null_places(spark):
    reads = spark.createDataFrame([(None, "a", 1), (3, "a", 2), (2, "a", 3), (None, "b", 4)], "i int, k string, x int")
    kept = spark.createDataFrame([("a",), ("b",)], "seq string")
    assert sorted(r["x"] for r in first_records(reads, kept, F.col("k"), F.col("i")).collect()) == [3, 4]


def test_a_task_hands_on_a_row_a_key(spark):
    """Every read was sorted by its key before first rows were taken."""
    rows = spark.range(0, 4000, 1, 2).select(F.format_string("%05d", F.col("id")).alias("name"), F.element_at(F.array(*map(F.lit, ["AAAA", "CCCC", "TTTT"])), (F.col("id") % 3 + 1).cast("int")).alias("s"))
    plan = clusters_module.counted_records(rows, F.lit(True), F.col("s"), F.col("name"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Sort" not in plan[plan.index("MapInArrow") :]
    assert combine.combined(rows.select(F.col("s").alias("seq"), F.lit(True).alias("_counts"), F.col("name").alias("_place"))).count() == 6


@pytest.mark.parametrize("bounds", [(1 << 16, 1 << 26), (7, 1 << 26), (7, 1)])
@pytest.mark.parametrize("kind", ["string", "int", "struct<a:string,b:int>", "double"])
def test_combined_rows_are_those_of_plain_python(spark, monkeypatch, bounds, kind):
    """Places with nulls, ties, other alphabets; keys with nulls; tasks that combine often, or hand on at once (double: without Arrow)."""
    rng = random.Random(11)
    pick = {
        "string": lambda: rng.choice([None, "", "a", "B", "é", "zz", "\U0001f600", "\uffff", f"x{rng.random()}"]),
        "int": lambda: rng.choice([None, rng.randrange(-900, 900)]),
        "struct<a:string,b:int>": lambda: rng.choice([None, (rng.choice([None, "a", "é", "\U0001f600", "\uffff"]), rng.choice([None, rng.randrange(-90, 90)]))]),
        "double": lambda: rng.choice([None, float("nan"), rng.random()]),
    }[kind]
    rows = [(rng.choice([None, "A", "C", "é", *"GT" * 5]), pick(), rng.choice([None, "III", "55I", "5", "", "I~!"]), [(str(i), None)]) for i in range(300)]
    reads = spark.createDataFrame(rows, f"k string, p {kind}, q string, `odd.name` array<struct<x:string,y:int>>").repartition(3)

    def rank(p):
        text = lambda t: (t is not None, (t or "").encode())
        number = lambda x: (x is not None, x is not None and x != x, 0 if x is None or x != x else x)
        return (p is None, () if p is None else (text(p[0]), number(p[1])) if isinstance(p, tuple) else text(p) if isinstance(p, str) else number(p))

    kept = lambda q: not q or not sum(10 ** -((ord(c) - 33) / 10) for c in q) / len(q) > 0.001
    want = {k: (sum(kept(q) for kk, _, q, _ in rows if kk == k), sum(kk == k for kk, *_ in rows), min(rank(p) for kk, p, *_ in rows if kk == k)) for k in {r[0] for r in rows}}
    monkeypatch.setattr(combine, "GATHER_ROWS", bounds[0])
    monkeypatch.setattr(combine, "HELD_BYTES", bounds[1])
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 10)
    try:
        got = combine.counted_records(reads, passes(F.col("q"), 0.001), F.col("k"), F.col("p"), (F.col("q"), passes_arrow(0.001))).collect()
    finally:
        spark.conf.set(setting, before)
    assert {g["seq"]: (g["n"], g["m"], rank(g["r"]["p"] if not hasattr(g["r"]["p"], "asDict") else tuple(g["r"]["p"]))) for g in got} == want and len(got) == len(want)
    by = {r[3][0][0]: r for r in rows}
    assert all(by[g["r"]["odd.name"][0]["x"]][:1] == (g["seq"],) and by[g["r"]["odd.name"][0]["x"]][2] == g["r"]["q"] for g in got)


@pytest.mark.parametrize(("key", "quality", "message"), [("AC", "I\x1f", "outside of valid phred range: I"), ("AC", "Ié", "must be ASCII encoded: Ié"), ("é", "II", "keys must be ASCII encoded: é")])
def test_combined_reads_are_checked(spark, key, quality, message):
    rows = spark.createDataFrame([("1", "AC", "II"), ("2", key, quality), ("3", "AC", None)], "name string, s string, q string")
    job = Deduplication(rows, [F.col("s")], [F.col("q")], F.col("name"), DedupOptions())
    with pytest.raises(Exception, match=message):
        job.output.collect()
