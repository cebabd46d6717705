"""Secret scans by an incremental ledger of blobs.

A path (a document, a file in a commit) has versions; a version's content is a blob, addressed by its SHA-256.  The ledger
holds what each (blob, rule version) pair gave, in a folder or as a table.  A scan reads only pairs that the ledger lacks, once each however many
paths hold the blob, and joins the findings back to all paths.

Defined results: a null text is the empty text; an empty table gives an empty result; repeated rows and paths each keep
their row; extra columns are ignored; nothing is cut from long texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, scratch

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt")
#: Raise it with any change of a rule: pairs of the new version are unseen, and so are scanned.
RULE_VERSION = 1
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER = f"blob binary, rule_version int, spans {SPANS}"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more: greedy runs start where the character before is outside, so shorter runs need not be matched.
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\t\r\n]+-----END [A-Z ]*PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
#: What every match of _ASSIGN has, in lower case: plain searches decide whether its pattern is tried at all.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["blob", "spans"])


def _addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("blob", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))


def _unseen(rows: DataFrame, ledger: DataFrame | None, rule_version: int) -> DataFrame:
    """(blob, rule_version, spans) of the pairs that the ledger lacks, stored."""
    # One text for each blob: copies meet in the map-side combine before anything is sent, however many there are.
    once = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        # Addresses are compared first: if all are known, no text moves at all.
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        new = checkpoint(rows.select("blob").distinct().join(known, "blob", "left_anti"))
        if new.isEmpty():
            return ledger.select(*(F.col(c) for c in ("blob", "rule_version", "spans"))).limit(0)
        once = once.join(new, "blob", "left_semi")
    return checkpoint(map_arrow(once, _scan, f"blob binary, spans {SPANS}").select("blob", F.lit(rule_version).alias("rule_version"), "spans"))


def _findings(rows: DataFrame, ledger: DataFrame, rule_version: int) -> DataFrame:
    """(path, blob, spans) of all rows, by the ledger.  Both sides come straight from what is stored, so a blob that very many paths hold can be split."""
    now = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    return rows.select("path", "blob").join(now, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(versions: DataFrame, path: str = "path", text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) for every row of versions, and the grown ledger (blob, rule_version, spans).

    Give each row of `ledger` back in the next call: blobs in it under this rule version are not read again.
    The ledger returned is a checkpointed table; scan_stored() keeps it in a folder instead.
    """
    rows = _addressed(versions, path, text)
    new = _unseen(rows, ledger, rule_version)
    grown = new if ledger is None else new.unionByName(ledger.select("blob", "rule_version", "spans"))
    return _findings(rows, grown, rule_version), grown


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in a folder, or None if nothing was written there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else None


def scan_stored(versions: DataFrame, folder: str, path: str = "path", text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) for every row of versions, read through the ledger in `folder`, to which what had not been scanned is appended first.

    An append is one job's commit: if it fails, the ledger is as it was, and the next call scans the same pairs.  One call at a time may write.
    """
    spark = versions.sparkSession
    rows = _addressed(versions, path, text)
    _unseen(rows, stored_ledger(spark, folder), rule_version).write.mode("append").parquet(folder)
    return _findings(rows, stored_ledger(spark, folder), rule_version)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document the counts, the digest of the base spans and all spans as text, read through the ledger in `folder` (a new one if None).

    Documents come as two deliveries, each scanned against the ledger that is stored by then: the second one's copies of the
    first one's blobs are not read again.
    """
    folder = folder or scratch(docs.sparkSession, "ledger")
    rows = docs.select("doc_id", "text")
    early = F.xxhash64("doc_id") < 0
    scan_stored(rows.filter(early), folder, "doc_id")
    second = scan_stored(rows.filter(~early), folder, "doc_id")
    first = _findings(_addressed(rows.filter(early), "doc_id", "text"), stored_ledger(docs.sparkSession, folder), RULE_VERSION)
    found = first.unionByName(second)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span found replaced by [SECRET] (n_chars follows); rows and columns stay."""
    found, _ = scan(docs.select("doc_id", "text"), "doc_id")
    marked = found.filter(F.size("spans") > 0).select(F.col("path").alias("doc_id"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).dropDuplicates(["doc_id", "_blob"])
    blob = F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("_id"), blob.alias("_hash"))
    own = F.col("row.text")
    out = rows.join(marked, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_blob")), "left")
    # Spans can overlap (hex inside assign): keep each stretch of text that no span covers.
    start = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(own, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("[SECRET]"))).otherwise(a["out"]).alias("out"),
    ), lambda a: F.concat(a["out"], F.substring(own, a["at"].cast("int") + 1, F.length(own))))
    text = F.when(F.col("_spans").isNotNull(), start).otherwise(own)
    row = F.col("row").withField("text", text)
    row = row.withField("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else row
    return out.select(row.alias("row")).select("row.*")
