"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, checkpoint, scratch, shared_folder, ship  # noqa: F401

U64 = np.uint64


#: Bytes of a batch that goes to a Python worker: rows can be long texts, of which ten thousand are too many at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sends this package's sources along, and bounds what a session sends to Python at once, where its bound is above BATCH_BYTES."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives what a worker has freed back to the machine: workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of bounded size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """df's rows as one column `row`, beside some of its columns: names that operators add cannot clash with its own."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows, so that each piece holds about max_bytes of text (one longer row stays whole)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    block = (np.cumsum(sizes) - sizes) // max_bytes
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and their offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), vectorised."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Word characters: all bytes but space and \t \n \v \f \r.  Letters A to Z fold to lower case.
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: An odd base has an inverse modulo 2**64, so a hash of any span comes from one running sum.
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, (n + 1) * 5 // 4)
        full = np.full(size, base, U64)
        full[0] = 1
        have = np.cumprod(full, dtype=U64)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """For each span the sum of values[i] * base**(i - start), modulo 2**64, then mixed."""
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(base, len(values))[: len(values)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(inverse, len(values))[starts])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end (bytes) of every word, and of every row the place of its first word (one more at the end)."""
    inside = WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    values = (LOWER[data] if fold else data).astype(U64) + U64(1)
    return span_hash(values, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words, and the row of each.  A row of fewer words has one shingle of all its words."""
    counts = np.diff(first)
    many = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(counts)), many)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][rows]
    return span_hash(hashes, starts, np.minimum(starts + width, first[1:][rows])), rows


def remainder(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % modulus


#: Bytes of the texts that a sample may have for each label; its first text counts whatever its size.
SAMPLE_BYTES = 32 << 20


def labelled_sample(rows: DataFrame, label: str, per_label: int, seed: int, keep: tuple[str, ...] = (), max_bytes: int = SAMPLE_BYTES) -> tuple[list, dict]:
    """At most per_label rows of each label, those with the smallest seeded hash of doc_id; and the counts of all labels.

    Labels are counted first, so that a hash threshold keeps about three times what is needed: only that many ids come
    to the driver, and only the chosen rows' texts.  Of an id's rows of one label the one with the smallest text counts; texts that
    would go beyond max_bytes for their label are passed over.  rows: doc_id, text, its size in bytes and the label, without nulls, and the
    columns `keep`; sizes are made before any join, so that the choice moves no text.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return [], {}
    place = F.xxhash64("doc_id", F.lit(seed))
    top = (1 << 63) - 1
    limits = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(top, int(top * (2 * min(1.0, (3 * per_label + 30) / n) - 1)))).cast("long"))))
    near = rows.filter(place <= limits[F.col(label)])
    sizes = near.groupBy("doc_id", label).agg(F.max("size").alias("size")).select("doc_id", label, "size", place.alias("place"))
    taken, room, ids = dict.fromkeys(counts, 0), dict.fromkeys(counts, max_bytes), set()
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], r["doc_id"])):
        k = r[label]
        if taken[k] < per_label and (r["size"] <= room[k] or not taken[k]):
            taken[k], room[k] = taken[k] + 1, room[k] - r["size"]
            ids.add((r["doc_id"], k))
    chosen = near.filter(F.col("doc_id").isin(sorted({i for i, _ in ids}))).groupBy("doc_id", label).agg(F.min(F.struct("text", *keep)).alias("r")).select("doc_id", label, "r.*").collect()
    return sorted((r for r in chosen if (r["doc_id"], r[label]) in ids), key=lambda r: (r["doc_id"], r["text"])), counts
