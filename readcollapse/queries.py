"""Queries over reads made of the lineitem table, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.distance import hamming_distance, within_distance
from .functions.quality import average_error_rate, average_error_rate_arrow, quality_filter
from .functions.records import are_mates, numbered, zipped
from .functions.slices import is_ascii, key, quality_key, slice_text
from .operators import clusters as c
from .operators import shape
from .operators.pairs import contains
from .options import DedupOptions, parse_slices
from .plans.pipeline import Deduplication
from .runtime import scratch
from .sources.fastq import read_fastq, write_fastq

#: Keys: how many, how long, how often a letter changes once and twice, and by how much lengths vary.
VARIANTS = {
    "dense": {"M": 150, "L": 8, "S1": "0123", "S2": "0123", "V": 0},
    "sparse": {"M": 300, "L": 10, "S1": "0", "S2": "", "V": 0},
    "varlen": {"M": 100, "L": 12, "S1": "0", "S2": "", "V": 1},
}
HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
RATE = 0.001


def reads_sql(variant: str, table: str = "lineitem") -> str:
    """Runs alike in Spark and DuckDB: reads with a molecule tag as sequence, from hashes of the row's columns."""
    v = VARIANTS[variant]
    at = lambda i: f"instr('{HEX}', substr(h, {i}, 1))"
    changed = lambda k, s, p, n: f"CASE WHEN instr('{s}', substr(h, {n}, 1)) > 0 THEN concat(substr({k}, 1, {at(p)} % {v['L']}), translate(substr(h, {p + 1}, 1), '{HEX}', '{BASES}'), substr({k}, {at(p)} % {v['L']} + 2)) ELSE {k} END"
    size = f"{v['L']} - {v['V']} * ({at(7)} % 2)"
    fields = ", '-', ".join(f"cast({x} AS varchar(20))" for x in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))
    return f"""SELECT h AS name, substr(k2, 1, {size}) AS sequence, translate(substr(h, 9, {size}), '{HEX}', 'IIIIIIIIIIIIIIH5') AS qualities
        FROM (SELECT h, {changed("k1", v["S2"], 4, 6)} AS k2
        FROM (SELECT h, {changed("k0", v["S1"], 1, 3)} AS k1
        FROM (SELECT translate(substr(md5(cast(l_partkey % {v["M"]} AS varchar(20))), 1, {v["L"]}), '{HEX}', '{BASES}') AS k0, md5(concat({fields})) AS h FROM {table}) a) b) d"""


def reads(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return spark.sql(reads_sql(variant, "{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def job(spark: SparkSession, sf_dir: str, variant: str, **options) -> Deduplication:
    return Deduplication(reads(spark, sf_dir, variant), [F.col("sequence")], [F.col("qualities")], F.col("name"), DedupOptions(**options))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def _rated(variant: str) -> str:
    """Common tables `reads` and `rated`, with the left-to-right mean of error rates."""
    return f"""reads AS ({reads_sql(variant)}),
        rated AS (SELECT *, list_reduce(list_transform(string_split(qualities, ''), lambda x: pow(10, -((ascii(x) - 33) / 10.0::double))), lambda x, y: x + y) / length(qualities) AS rate FROM reads)"""


def _keys(variant: str) -> str:
    return f"{_rated(variant)}, k AS MATERIALIZED (SELECT sequence AS seq, count(*) AS n FROM rated WHERE NOT (rate > {RATE}) GROUP BY 1)"


def _near(metric: str, most: int) -> str:
    if metric == "hamming":
        return f"CASE WHEN length(a.seq) = length(b.seq) THEN hamming(a.seq, b.seq) <= {most} ELSE false END"
    return f"abs(length(a.seq) - length(b.seq)) <= {most} AND levenshtein(a.seq, b.seq) <= {most}"


def _links(variant: str, metric: str, most: int = 1) -> str:
    return f"WITH RECURSIVE {_keys(variant)}, e AS MATERIALIZED (SELECT a.seq AS a, a.n AS an, b.seq AS b, b.n AS bn FROM k a JOIN k b ON a.seq <> b.seq AND {_near(metric, most)})"


_LABELS = "r(seq, l) AS (SELECT seq, seq FROM k UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.seq), comp AS (SELECT seq, min(l) AS l FROM r GROUP BY 1)"
_KEPT = {
    "highest_count": f"{_LABELS}, s AS (SELECT arg_max(seq, (n, seq)) AS seq FROM comp JOIN k USING (seq) GROUP BY l)",
    "directional": """ones(seq, l) AS (SELECT seq, seq FROM k WHERE n = 1 UNION SELECT e.b, o.l FROM ones o JOIN e ON e.a = o.seq WHERE e.bn = 1),
        comp AS (SELECT seq, min(l) AS l FROM ones GROUP BY 1), hot AS (SELECT DISTINCT b FROM e WHERE an >= 2 AND bn = 1), dom AS (SELECT DISTINCT b FROM e WHERE bn >= 2 AND an >= 2 * bn - 1),
        s AS (SELECT seq FROM k WHERE n >= 2 AND seq NOT IN (SELECT b FROM dom) UNION ALL SELECT max(comp.seq) FROM comp LEFT JOIN hot ON hot.b = comp.seq GROUP BY l HAVING count(hot.b) = 0)""",
    "adjacency": """t(i, seq, st) AS (SELECT 0, seq, 0 FROM k UNION ALL
        SELECT i + 1, seq, CASE WHEN st <> 0 THEN st WHEN kept > 0 THEN 2 WHEN dom = 0 THEN 1 ELSE 0 END FROM (
          SELECT t.i, t.seq, t.st,
            (SELECT count(*) FROM e JOIN t t2 ON t2.seq = e.a WHERE e.b = t.seq AND t2.st = 0 AND (e.an, e.a) > (e.bn, e.b)) AS dom,
            (SELECT count(*) FROM e JOIN t t2 ON t2.seq = e.a WHERE e.b = t.seq AND t2.st = 1) AS kept
          FROM t WHERE EXISTS (SELECT 1 FROM t WHERE st = 0))),
        s AS (SELECT seq FROM t WHERE i = (SELECT max(i) FROM t) AND st = 1)""",
}


@query(f"WITH {_rated('dense')} SELECT name, rate FROM rated")
def error_rate(spark, sf_dir):
    return reads(spark, sf_dir, "dense").select("name", average_error_rate(F.col("qualities")).alias("rate"))


@query(ORACLES["error_rate"])
def error_rate_arrow(spark, sf_dir):
    return reads(spark, sf_dir, "dense").select("name", average_error_rate_arrow()(F.col("qualities")).alias("rate"))


@query(f"WITH {_rated('dense')} SELECT name, sequence, qualities FROM rated WHERE NOT (rate > {RATE})")
def filter_by_quality(spark, sf_dir):
    return quality_filter(reads(spark, sf_dir, "dense"), F.col("qualities"), RATE)


@query(f"WITH {_rated('dense')} SELECT count(*) AS total, count(*) FILTER (rate > {RATE}) AS discarded FROM rated")
def quality_summary(spark, sf_dir):
    """What the filter observes while reads pass it."""
    seen = Observation()
    quality_filter(reads(spark, sf_dir, "dense"), F.col("qualities"), RATE, observed=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["total"], seen.get["discarded"])], "total long, discarded long")


@query(f"WITH reads AS ({reads_sql('varlen')}) SELECT name, substr(sequence, 1, 5) AS s1, substr(sequence, 3, 5) AS s2, substr(sequence, greatest(length(sequence) - 4, 1), 4) AS s3, substr(sequence, 9) AS s4, '' AS s5 FROM reads")
def key_slices(spark, sf_dir):
    parts = parse_slices("5,2:7,-5:-1,8:,7:3")
    return reads(spark, sf_dir, "varlen").select("name", *(slice_text(F.col("sequence"), p).alias(f"s{i}") for i, p in enumerate(parts, 1)))


@query(f"""WITH reads AS ({reads_sql('varlen')}) SELECT name, reverse(sequence) AS s1, concat(substr(sequence, 1, 1), substr(sequence, 4, 1), substr(sequence, 7, 1), substr(sequence, 10, 1)) AS s2,
        concat(substr(sequence, length(sequence) - 1, 1), substr(sequence, length(sequence) - 3, 1), substr(sequence, length(sequence) - 5, 1)) AS s3 FROM reads""")
def key_steps(spark, sf_dir):
    parts = parse_slices("::-1,::3,-2:-7:-2")
    return reads(spark, sf_dir, "varlen").select("name", *(slice_text(F.col("sequence"), p).alias(f"s{i}") for i, p in enumerate(parts, 1)))


@query(f"WITH reads AS ({reads_sql('dense')}) SELECT concat(substr(sequence, 1, 3), substr(reverse(sequence), 3, 4)) AS seq, count(*) AS n FROM reads GROUP BY 1")
def multi_file_key(spark, sf_dir):
    rows = reads(spark, sf_dir, "dense")
    return c.count_keys(rows, key([F.col("sequence"), F.reverse("sequence")], parse_slices("3,2:6")))


@query(f"""WITH reads AS ({reads_sql('dense')}) SELECT name, CASE WHEN name < '4' THEN substr(qualities, 1, 2) ELSE concat(substr(qualities, 1, 2), substr(reverse(qualities), 4, 3)) END AS q FROM reads""")
def quality_key_with_missing(spark, sf_dir):
    first = F.when(F.col("name") >= "4", F.col("qualities"))
    second = F.when(F.col("name") >= "4", F.reverse("qualities")).otherwise(F.col("qualities"))
    return reads(spark, sf_dir, "dense").select("name", quality_key([first, second], parse_slices("2,3:6")).alias("q"))


@query(f"WITH {_keys('dense')} SELECT seq, n FROM k")
def key_counts(spark, sf_dir):
    return job(spark, sf_dir, "dense").keys


@query(f"WITH {_keys('dense')} SELECT count(*) AS distinct_keys, sum(n)::BIGINT AS total, max(length(seq))::INT AS longest FROM k")
def key_summary(spark, sf_dir):
    return job(spark, sf_dir, "dense").keys.agg(F.count(F.lit(1)).alias("distinct_keys"), F.sum("n").alias("total"), F.max(F.length("seq")).alias("longest"))


@query(f"WITH {_keys('dense')} SELECT seq, n, seq AS cluster_id FROM k")
def exact_clusters(spark, sf_dir):
    return job(spark, sf_dir, "dense", max_distance=0).clusters


@query("""SELECT a.n_nationkey AS x, b.n_nationkey AS y, CASE WHEN length(a.n_name) = length(b.n_name) THEN hamming(a.n_name, b.n_name)::INT END AS apart,
        length(a.n_name) = length(b.n_name) AND CASE WHEN length(a.n_name) = length(b.n_name) THEN hamming(a.n_name, b.n_name) <= 2 ELSE false END AS near, levenshtein(a.n_name, b.n_name) <= 3 AS edits
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def distances(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("x"), F.col("n_name").alias("p")), n.select("n_regionkey", F.col("n_nationkey").alias("y"), F.col("n_name").alias("q"))
    p, q = F.col("p"), F.col("q")
    return a.join(b, "n_regionkey").select("x", "y", hamming_distance(p, q).alias("apart"), within_distance(p, q, 2).alias("near"), within_distance(p, q, 3, "levenshtein").alias("edits"))


def _pair_query(name: str, variant: str, metric: str, most: int) -> None:
    query(f"{_links(variant, metric, most)} SELECT a, an, b, bn FROM e WHERE a < b", name)(lambda spark, sf_dir: job(spark, sf_dir, variant, metric=metric, max_distance=most).pairs)


_pair_query("hamming_pairs_d1", "dense", "hamming", 1)
_pair_query("hamming_pairs_d2", "sparse", "hamming", 2)
_pair_query("edit_pairs_d1", "varlen", "levenshtein", 1)
_pair_query("edit_pairs_d2", "varlen", "levenshtein", 2)


@query(f"WITH {_keys('varlen')} SELECT seq, n FROM k WHERE n >= 3")
def delete_keys(spark, sf_dir):
    keys = job(spark, sf_dir, "varlen").keys
    return c.delete_keys(keys, keys.filter("n < 3").select("seq"))


def _contains_query(name: str, metric: str, most: int) -> None:
    def run(spark, sf_dir):
        keys = job(spark, sf_dir, "varlen").keys
        return contains(keys.filter("n >= 3"), keys.filter("n < 3").select("seq"), most, metric)

    near = "a.seq = b.seq" if most == 0 else _near(metric, most)
    query(f"WITH {_keys('varlen')} SELECT a.seq AS seq, EXISTS (SELECT 1 FROM k b WHERE b.n >= 3 AND {near}) AS found FROM k a WHERE a.n < 3", name)(run)


_contains_query("contains_exact", "hamming", 0)
_contains_query("contains_hamming", "hamming", 1)
_contains_query("contains_edit", "levenshtein", 1)


def _cluster_query(name: str, variant: str, metric: str) -> None:
    query(f"{_links(variant, metric)}, {_LABELS} SELECT seq, n, l AS cluster_id FROM comp JOIN k USING (seq)", name)(lambda spark, sf_dir: job(spark, sf_dir, variant, metric=metric).clusters)


_cluster_query("clusters_hamming", "sparse", "hamming")
_cluster_query("clusters_edit", "varlen", "levenshtein")


@query(f"{_links('sparse', 'hamming')}, {_LABELS} SELECT l AS cluster_id, count(*) AS keys, sum(n)::BIGINT AS reads FROM comp JOIN k USING (seq) GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return job(spark, sf_dir, "sparse").clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("reads"))


def _dissection_query(name: str, variant: str, metric: str, method: str) -> None:
    query(f"{_links(variant, metric)}, {_KEPT[method]} SELECT seq FROM s", f"dissect_{name}")(lambda spark, sf_dir: job(spark, sf_dir, variant, metric=metric, method=method).survivors)
    query(f"{_links(variant, metric)}, {_KEPT[method]} SELECT arg_min(name, name) AS name, sequence, arg_min(qualities, name) AS qualities FROM reads WHERE sequence IN (SELECT seq FROM s) GROUP BY sequence", f"dedup_output_{name}")(
        lambda spark, sf_dir: job(spark, sf_dir, variant, metric=metric, method=method).output
    )


_dissection_query("highest_count", "sparse", "hamming", "highest_count")
_dissection_query("highest_count_edit", "varlen", "levenshtein", "highest_count")
_dissection_query("adjacency", "dense", "hamming", "adjacency")
_dissection_query("adjacency_edit", "varlen", "levenshtein", "adjacency")
_dissection_query("directional", "dense", "hamming", "directional")
_dissection_query("directional_edit", "varlen", "levenshtein", "directional")


@query(f"{_links('sparse', 'hamming')}, {_LABELS} SELECT min(seq) AS seq FROM comp GROUP BY l")
def dissect_custom(spark, sf_dir):
    """A dissection of one's own: here the smallest key of each cluster."""
    return c.custom(job(spark, sf_dir, "sparse").clusters, lambda frame: frame.nsmallest(1, "seq") if frame["seq"].dtype.kind != "O" else frame.sort_values("seq").head(1))


@query(f"""{_links('dense', 'hamming')}, {_KEPT['directional']} SELECT (SELECT count(*) FROM rated) AS total, (SELECT count(*) FROM rated WHERE rate > {RATE}) AS discarded, (SELECT count(*) FROM k) AS distinct_keys, (SELECT count(*) FROM s) AS kept""")
def dedup_summary(spark, sf_dir):
    one = job(spark, sf_dir, "dense")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    return quality_summary(spark, sf_dir).withColumn("_one", F.lit(1)).join(count(one.keys, "distinct_keys"), "_one").join(count(one.survivors, "kept"), "_one").drop("_one")


@query(f"""WITH x AS ({reads_sql('dense')}), y AS ({reads_sql('sparse')}), a AS (SELECT row_number() OVER (ORDER BY name) - 1 AS rec_idx, sequence AS s1 FROM x),
        b AS (SELECT row_number() OVER (ORDER BY name) - 1 AS rec_idx, sequence AS s2 FROM y WHERE name < 'f') SELECT rec_idx, s1, s2 FROM a JOIN b USING (rec_idx)""")
def positional_zip(spark, sf_dir):
    a = numbered(reads(spark, sf_dir, "dense").select("name", F.col("sequence").alias("s1")), "name", "s1", keep=["s1"])
    b = numbered(reads(spark, sf_dir, "sparse").filter("name < 'f'").select("name", F.col("sequence").alias("s2")), "name", "s2", keep=["s2"])
    return zipped(a, b)


@query(f"""WITH r AS ({reads_sql('dense')}), m AS (SELECT concat(substr(name, 1, 12), '1 first') AS n1, concat(substr(name, 1, 11), CASE WHEN name < '8' THEN substr(name, 12, 1) ELSE 'x' END, '2') AS n2 FROM r)
        SELECT n1, n2, regexp_replace(regexp_extract(n1, '^([^ \t]*)', 1), '[123]$', '') = regexp_replace(regexp_extract(n2, '^([^ \t]*)', 1), '[123]$', '') AS mates FROM m""")
def mate_check(spark, sf_dir):
    r = reads(spark, sf_dir, "dense").select(F.concat(F.substring("name", 1, 12), F.lit("1 first")).alias("n1"), F.concat(F.substring("name", 1, 11), F.when(F.col("name") < "8", F.substring("name", 12, 1)).otherwise("x"), F.lit("2")).alias("n2"))
    return r.select("n1", "n2", are_mates(F.array("n1", "n2")).alias("mates"))


@query("SELECT count(*) AS total, count(*) FILTER (octet_length(encode(text)) <> length(text)) AS rejected FROM documents")
def ascii_check(spark, sf_dir):
    """Texts that keys may not be made of."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("total"), F.count_if(~is_ascii(F.col("text"))).alias("rejected"))


@query(f"WITH {_keys('dense')}, l AS (SELECT DISTINCT unnest(string_split(seq, '')) AS letter FROM k UNION SELECT 'N') SELECT letter, (row_number() OVER (ORDER BY instr('ACGTN', letter)) - 1)::INT AS place FROM l")
def alphabet(spark, sf_dir):
    return shape.letters(job(spark, sf_dir, "dense").keys, shape.ALPHABET)


_SHAPE = """p AS (SELECT i AS layer, substr(seq, 1, i) AS prefix, length(seq) AS size, instr('ACGTN', substr(seq, i + 1, 1)) * (i < length(seq))::INT AS nxt FROM (SELECT seq, unnest(range(length(seq) + 1)) AS i FROM k)),
        g AS (SELECT layer, prefix, count(*) AS m, max(nxt) AS capacity, max(size) AS size FROM p GROUP BY 1, 2),
        nodes AS (SELECT g.layer, CASE WHEN m = 1 THEN 0 ELSE capacity END AS capacity, CASE WHEN m = 1 THEN size - layer ELSE 0 END AS suffix FROM g WHERE layer = 0 OR EXISTS (SELECT 1 FROM g h WHERE h.m >= 2 AND h.layer = g.layer - 1 AND h.prefix = substr(g.prefix, 1, g.layer - 1)))"""


@query(f"WITH {_keys('varlen')}, {_SHAPE} SELECT layer::INT AS layer, capacity::INT AS capacity, count(*) AS nodes, sum(8 + 8 * capacity + suffix)::BIGINT AS bytes FROM nodes GROUP BY 1, 2")
def trie_shape(spark, sf_dir):
    return shape.shape(job(spark, sf_dir, "varlen").keys)


@query(f"WITH {_keys('varlen')}, {_SHAPE} SELECT sum(8 + 8 * capacity)::BIGINT AS node_bytes, sum(suffix)::BIGINT AS suffix_bytes, sum(8 + 8 * capacity + suffix)::BIGINT AS total_bytes FROM nodes")
def trie_memory(spark, sf_dir):
    return shape.memory(job(spark, sf_dir, "varlen").keys)


@query(f"WITH r AS ({reads_sql('sparse')}) SELECT row_number() OVER (ORDER BY name, sequence) - 1 AS rec_idx, name, sequence, qualities, reverse(sequence) AS mate FROM r")
def fastq_round_trip(spark, sf_dir):
    """Reads and their mates, written as two compressed FASTQ files and read again."""
    rows = numbered(reads(spark, sf_dir, "sparse"), "name", "sequence", in_order=True)
    record = lambda s: F.struct("name", F.col(s).alias("sequence"), "qualities")
    rows = rows.withColumn("mate", F.reverse("sequence")).select(F.lit(0).alias("file_set"), "rec_idx", F.array(record("sequence"), record("mate")).alias("mates"))
    folder = scratch(spark, "round-trip")
    paths = [f"{folder}-{i}.fastq.gz" for i in (1, 2)]
    write_fastq(rows, paths, ordered=True)
    back = read_fastq(spark, paths)
    return back.select("rec_idx", F.col("mates")[0]["name"].alias("name"), F.col("mates")[0]["sequence"].alias("sequence"), F.col("mates")[0]["qualities"].alias("qualities"), F.col("mates")[1]["sequence"].alias("mate"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, count, join by distance, choose representatives, return their first records."""
    return job(spark, sf_dir, "dense").output
