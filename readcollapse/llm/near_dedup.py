"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text is its set of five-word shingles (letters folded, white space as the only separator), each weighing (1 + ln tf) * idf.
idf is 1 + ln(1 / df), df being the share of documents that hold the shingle, from DF_FLOOR to 1: what is rarer than the floor
weighs the same.  Document frequencies come from all documents by a counting table of 2**20 places of shingle hashes;
a place adds others' counts of about (shingles of a mean document) / 2**20 of all documents, far below the floor at any
size of the corpus, so the table's size is fixed.

Each of SAMPLES consistent weighted samples (Ioffe 2010: r and c from Gamma(2, 1), beta uniform) agrees between two texts
with a probability of their weighted Jaccard similarity.  ROWS samples make a band; texts that share a band are candidates, and
a candidate pair is a link if its weighted Jaccard similarity, computed exactly from the whole texts, is SIMILARITY or more.

Texts of the same words are one class, and links are between classes.  Each band's members are held against its smallest
one; members that this leaves in different components of links are then held against each other, in pairs if the band's rest
is small and in blocks by matrix products if it is large, so no link that joins components is lost and no group is
expanded into pairs or read by one task.

Defined results: null, empty and wordless texts link with nothing; a text of one to four words is one shingle; an empty table
gives an empty result; repeated rows are one class; a null doc_id stays by itself; texts of different words are different
classes though they share a doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import U64, checkpoint, map_arrow, mix, packed, shingles, span_hash, text_slices, utf8, words
from ..operators.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 3
DF_FLOOR = 0.05
DF_BITS = 20
#: A band whose rest makes at most so many pairs is compared in pairs, a larger one in blocks of BLOCK texts a side.
PAIRS = 4096
BLOCK = 192

#: Shingles are 50 bits, so that one 64-bit key holds a row of a slice (up to 8192) and a shingle.
_HASH = 50
_SLICES = 16


def _keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, shingle) keys without repeats, how often each occurs, and the word hashes and first words of rows."""
    data, offsets = utf8(text)
    hashes, _, _, first = words(data, offsets)
    sh, rows = shingles(hashes, first, WIDTH)
    keys = np.sort((rows.astype(U64) << U64(_HASH)) | (sh >> U64(64 - _HASH)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), hashes, first


def _split(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, and where each row begins (one more at the end)."""
    return keys & U64((1 << _HASH) - 1), np.searchsorted(keys, np.arange(rows + 1).astype(U64) << U64(_HASH))


def _place(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U64(_HASH - DF_BITS)).astype(np.int64)


def _pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batch, column, 1 << 20):
        for at in range(0, piece.num_rows, 8192):
            yield piece.slice(at, 8192)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        for piece in _pieces(batch):
            keys, _, _, first = _keys(piece.column("text"))
            counts += np.bincount(_place(keys & U64((1 << _HASH) - 1)), minlength=1 << DF_BITS)
            docs += int((np.diff(first) > 0).sum())
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    if docs:
        parts = counts.reshape(_SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "part": pa.array([part] * _SLICES, pa.int32()), "docs": pa.array([docs] * _SLICES, pa.int64()), "counts": pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts], pa.binary())})


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << DF_BITS) // _SLICES, np.int64)
    for blob in group["counts"]:
        total += np.frombuffer(zlib.decompress(blob), "<i8")
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": [0], "docs": [group["docs"].sum()], "counts": [zlib.compress(total.tobytes(), 1)]})


def idf_table(docs: DataFrame) -> tuple[np.ndarray, int]:
    """idf of every place of the counting table (float32, 4 MB whatever the input), from all documents; and the number of those with words."""
    schema = "slice int, part int, docs long, counts binary"
    parts = map_arrow(docs.select("text"), _count, schema)
    # Summed in two steps, so that no task reads what all tasks have counted.
    parts = parts.groupBy("slice", (F.col("part") % 128).alias("_g")).applyInPandas(_sum, schema).groupBy("slice").applyInPandas(_sum, schema)
    got = parts.collect()
    counts = np.zeros((_SLICES, (1 << DF_BITS) // _SLICES))
    n = max((r["docs"] for r in got), default=0)
    for r in got:
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return (1 - np.log(np.clip(counts.ravel() / max(n, 1), DF_FLOOR, 1))).astype(np.float32), n


def weigh(text: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and weights of all rows, where each row begins, and the word hashes and first words of rows."""
    keys, tf, hashes, first = _keys(text)
    shingle, begin = _split(keys, len(text))
    weight = idf[_place(shingle)]
    many = tf > 1
    weight[many] *= 1 + np.log(tf[many]).astype(np.float32)
    return shingle, weight, begin, hashes, first


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal shares, by bisection: no long table is made."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(50):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high.astype(np.float32)


_tables: list[np.ndarray] = []


def samples(shingle: np.ndarray, weight: np.ndarray, begin: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """count consistent weighted samples (64-bit codes) of each row; every row has a shingle at least."""
    if not _tables:
        r = _gamma2()
        _tables.extend([r, np.log(r)])
    r_of, logc_of = _tables
    logw = np.log(weight)
    own = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out = np.empty((len(begin) - 1, count), U64)
    for j in range(count):
        u = (shingle + U64(j + 1)) * U64((0x9E3779B97F4A7C15 * (2 * j + 3)) & ((1 << 64) - 1))
        u ^= u >> U64(29)
        u *= U64(0xBF58476D1CE4E5B9)
        u ^= u >> U64(32)
        r = r_of[(u & U64(0xFFFF)).astype(np.int32)]
        beta = ((u >> U64(16)) & U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(logw / r + beta)
        c = logc_of[((u >> U64(32)) & U64(0xFFFF)).astype(np.int32)]
        la = c - r * (t - beta + 1)
        low = np.minimum.reduceat(la, begin[:-1])
        hit = np.flatnonzero(la == low[own])
        rows = own[hit]
        lead = np.ones(len(hit), bool)
        lead[1:] = rows[1:] != rows[:-1]
        at = hit[lead]
        out[:, j] = mix(shingle[at] * U64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(U64) * U64(0xD1342543DE82EF95) + U64(j))
    return out


def _address(hashes: np.ndarray, first: np.ndarray, mask: np.ndarray) -> list[pa.Array]:
    return [pa.array(span_hash(hashes, first[:-1], first[1:], base).view(np.int64), mask=mask) for base in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, c1, c2, total, bands): class address, sum of weights and band codes; c1 is null for wordless texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                shingle, weight, begin, hashes, first = weigh(piece.column("text"), idf.value)
                full = np.diff(first) > 0
                n = piece.num_rows
                total = np.zeros(n)
                bands = np.zeros((n, BANDS), np.int64)
                if full.any():
                    own = np.append(begin[:-1][full], begin[-1])
                    total[full] = np.add.reduceat(weight.astype(np.float64), own[:-1])
                    codes = samples(shingle, weight, own).reshape(-1, BANDS, ROWS)
                    band = np.repeat(np.arange(BANDS, dtype=U64)[None], len(codes), axis=0)
                    for k in range(ROWS):
                        band = mix(band * U64(0x9E3779B97F4A7C15) + codes[:, :, k])
                    bands[full] = band.view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *_address(hashes, first, ~full), pa.array(total), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))], ["doc_id", "c1", "c2", "total", "bands"])

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, c1 long, c2 long, total double, bands array<long>")


def addressed(rows: DataFrame) -> DataFrame:
    """rows (text and others) with their class addresses c1 and c2, as signatures() gives them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                hashes, _, _, first = words(*utf8(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*piece.columns, *_address(hashes, first, np.diff(first) == 0)], [*piece.schema.names, "c1", "c2"])

    return map_arrow(rows, make, T.StructType([*rows.schema.fields, T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType())]))


def _similarity(ka, wa, kb, wb) -> float:
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka
    inter = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return inter / max(float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - inter, 1e-30)


def _verify(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "ta"):
                # Neighbouring rows often share b's text: each text is weighed once.
                both = pa.concat_arrays([piece.column("ta").cast(pa.large_string()), piece.column("tb").cast(pa.large_string())]).dictionary_encode()
                place = both.indices.to_numpy()
                parts = []
                for at in range(0, len(both.dictionary), 512):
                    shingle, weight, begin, _, _ = weigh(both.dictionary.slice(at, 512), idf.value)
                    parts += [(shingle[x:y], weight[x:y]) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                n = piece.num_rows
                value = np.array([_similarity(*parts[place[i]], *parts[place[n + i]]) for i in range(n)])
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(value, pa.float64())], ["a", "b", "similarity"]).filter(pa.array(value >= least))

    return run


def verify(pairs: DataFrame, texts: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """Rows of pairs (a, b) whose texts have a weighted Jaccard similarity of at least `least`.  texts: rep, text; one row a class."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return map_arrow(rows, _verify(idf, least), f"a {kind}, b {kind}, similarity double")


def _block(idf, least: float):
    """For one block: links between its left and right members that have different labels, enough of them to connect what is linked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        text = pa.array(pd.concat([left["text"], right["text"]]), pa.string())
        shingle, weight, begin, _, _ = weigh(text, idf.value)
        n, m = len(left), len(right)
        own = np.repeat(np.arange(n + m), np.diff(begin))
        # Equal shingles of different weights (by tf) are told apart by layers: the smaller weight is the shared part.
        order = np.argsort(shingle, kind="stable")
        s, o, w = shingle[order], own[order], weight[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        ids = np.cumsum(new) - 1
        shared = np.bincount(ids) > 1
        total = np.add.reduceat(weight.astype(np.float64), begin[:-1]) if len(weight) else np.zeros(n + m)
        inter = np.zeros((n, m), np.float32)
        keep = shared[ids]
        ids, o, w = ids[keep], o[keep], w[keep]
        levels = np.unique(w)
        floor = 0.0
        for level in levels:
            over = w >= level
            cols, place = np.unique(ids[over], return_inverse=True)
            for at in range(0, len(cols), 16384):
                inside = (place >= at) & (place < at + 16384)
                dense = np.zeros((n + m, min(16384, len(cols) - at)), np.float32)
                dense[o[over][inside], place[inside] - at] = 1
                inter += np.float32(level - floor) * (dense[:n] @ dense[n:].T)
            floor = float(level)
        union = total[:n, None] + total[None, n:] - inter
        near = inter >= (least - 1e-3) * union
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        near &= la[:, None] != lb[None]
        root = {x: x for x in (*la, *lb)}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        part = lambda k: (shingle[begin[k] : begin[k + 1]], weight[begin[k] : begin[k + 1]])
        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = find(la[i]), find(lb[j])
            if x != y and _similarity(*part(i), *part(n + j)) >= least:
                root[max(x, y)] = min(x, y)
                out.append((a[i], b[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def link(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, component_id, kept) of every row of docs (doc_id, text).

    class_id: the smallest id of the same words; component_id: the smallest that links reach; kept: that is this document (if linked
    texts share that id, one of them).
    """
    return _linked(docs, least)[0].select("doc_id", "class_id", "component_id", "kept")


def _linked(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """What link() gives, with class addresses c1 and c2; and the ids (_id) whose rows have several, if there are any."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    table, n = idf_table(docs)
    idf = spark.sparkContext.broadcast(table)
    sig = checkpoint(signatures(docs, idf))
    real = sig.filter("c1 is not null and doc_id is not null")
    cls = checkpoint(real.groupBy("c1", "c2").agg(F.min("doc_id").alias("smallest"), F.first("total").alias("total"), F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()), n)
    # Classes go by numbers (stored above, so they last): an id may be the smallest of several.
    banded = cls.select("rep", "total", F.explode("bands").alias("band"))
    heads = checkpoint(banded.groupBy("band").agg(F.min(F.struct("rep", "total")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"), n * BANDS // 2)
    many = checkpoint(banded.join(heads, "band").select("band", "rep", "total", F.col("head.rep").alias("head"), F.col("head.total").alias("head_total"), "n"), n * BANDS)
    in_bands = many.count()
    # A pair whose totals differ too much cannot be similar enough; the margin covers rounding.
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (least - 1e-3)
    pairs = many.filter((F.col("rep") != F.col("head")) & alike(F.col("total"), F.col("head_total"))).select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    wanted = checkpoint(cls.join(many.select("rep").distinct(), "rep", "left_semi").select("rep", "smallest", F.col("c1").alias("_1"), F.col("c2").alias("_2")), n)
    address = F.struct("c1", "c2")
    several = checkpoint(sig.filter("doc_id is not null").groupBy("doc_id").agg(F.min(address).alias("x"), F.max(address).alias("y")).filter("not x <=> y").select(F.col("doc_id").alias("_id")), n)
    several = None if several.isEmpty() else several
    own = docs if several is None else docs.join(several, F.col("doc_id") == F.col("_id"), "left_anti")
    texts = own.join(wanted, F.col("doc_id") == F.col("smallest")).dropDuplicates(["doc_id", "rep"]).select("rep", "text")
    if several is not None:
        shared = addressed(docs.join(several, F.col("doc_id") == F.col("_id"), "left_semi"))
        shared = shared.join(wanted, (F.col("doc_id") == F.col("smallest")) & (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")))
        texts = texts.union(shared.dropDuplicates(["doc_id", "c1", "c2", "rep"]).select("rep", "text"))
    texts = checkpoint(texts)
    links = checkpoint(verify(pairs, texts, idf, least).select("a", "b").repartition("a"), in_bands)
    labels = components(links)

    # What the heads have left apart.
    marked = many.join(labels, many["rep"] == labels["node"], "left").select("band", "rep", "total", "head", "n", F.coalesce("component", "rep").alias("label"))
    marked = checkpoint(marked, in_bands)
    per = marked.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = checkpoint(per.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), F.sum("k").alias("all"), F.max(F.struct("k", "label")).alias("big")).filter("labels > 1").select("band", F.col("big.label").alias("big"), (F.col("all") - F.col("big.k")).alias("rest"), "all"), in_bands // 2)
    if not mixed.isEmpty():
        members = checkpoint(marked.join(mixed, "band"), in_bands)
        minor = members.filter("label <> big")
        small = (F.col("rest") * F.col("all") <= PAIRS)
        x = minor.filter(small).select("band", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("total").alias("tx"), "head")
        y = members.filter(small).select("band", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("total").alias("ty"))
        rest = x.join(y, "band").filter((F.col("lx") != F.col("ly")) & (F.col("x") != F.col("head")) & (F.col("y") != F.col("head")) & alike(F.col("tx"), F.col("ty")))
        rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        more = checkpoint(verify(rest, texts, idf, least).select("a", "b"))
        # Large bands: every block of the rest against every block of all members.
        cut = lambda n: F.greatest(F.ceil(n / float(BLOCK)), F.lit(1)).cast("int")
        place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), cut(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), cut(n) - 1))
        left = minor.filter(~small).withColumn("i", place(1, F.col("rest"))).withColumn("j", spread(F.col("all"))).withColumn("side", F.lit(0))
        right = members.filter(~small).withColumn("j", place(2, F.col("all"))).withColumn("i", spread(F.col("rest"))).withColumn("side", F.lit(1))
        blocks = left.select("band", "i", "j", "side", "rep", "label").unionByName(right.select("band", "i", "j", "side", "rep", "label"))
        if not members.filter(~small).isEmpty():
            filled = blocks.join(texts, "rep")
            more = checkpoint(more.union(filled.groupBy("band", "i", "j").applyInPandas(_block(idf, least), "a long, b long")))
        if not more.isEmpty():
            labels = components(links.union(more))
    first = F.struct("smallest", "c1", "c2")
    named = checkpoint(cls.select("c1", "c2", "rep", "smallest").join(labels, cls["rep"] == labels["node"], "left").select("c1", "c2", "smallest", "component"), n)
    heads = named.filter("component is not null").groupBy("component").agg(F.min(first).alias("head")).withColumnRenamed("component", "_c")
    named = named.join(heads, F.col("component") == F.col("_c"), "left").withColumn("head", F.coalesce("head", first))
    named = checkpoint(named.select(F.col("c1").alias("_1"), F.col("c2").alias("_2"), "smallest", F.col("head.smallest").alias("component"), first.eqNullSafe(F.col("head")).alias("leads")), n)
    out = sig.select("doc_id", "c1", "c2").join(named, F.col("doc_id").isNotNull() & (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")), "left")
    out = out.select("doc_id", "c1", "c2", F.coalesce("smallest", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("leads")).drop("leads"), several


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group, that with the smallest id; documents without links stay.  Rows of an id and the same words are one."""
    linked, several = _linked(docs, least)
    kept = checkpoint(linked.filter("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("c1").alias("_1"), F.col("c2").alias("_2")))
    ids = kept.select("_id")
    repeated = not ids.groupBy("_id").count().filter("count > 1").isEmpty()
    rows = packed(docs, "doc_id")
    out = rows.filter("doc_id is not null")
    out = out if several is None else out.join(several, F.col("doc_id") == F.col("_id"), "left_anti")
    out = out.join(ids.distinct() if repeated else ids, F.col("doc_id") == F.col("_id"), "left_semi")
    out = out.dropDuplicates(["doc_id"]) if repeated else out
    if several is not None:
        # The id does not say which of its texts stays.
        shared = addressed(packed(docs, "doc_id", "text").join(several, F.col("doc_id") == F.col("_id"), "left_semi"))
        same = (F.col("doc_id") == F.col("_id")) & F.col("c1").eqNullSafe(F.col("_1")) & F.col("c2").eqNullSafe(F.col("_2"))
        out = out.unionByName(shared.join(kept, same, "left_semi").dropDuplicates(["doc_id", "c1", "c2"]).select("row", "doc_id"))
    return out.unionByName(rows.filter("doc_id is null")).select("row.*")
