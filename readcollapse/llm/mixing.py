"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Sizes are words.  Targets are apportioned to sources as equal-token blocks by highest quotients size/(2a+1), a source's
blocks to its shards in the same way, so every (source, shard) has an integer quota.  A shard is a ring of words: its
documents in seeded order, cut into blocks.  Its quota is a run of consecutive blocks from a seeded start, so each
document's share is interval arithmetic on its place in the ring; no block is ever a row.

Defined results: null text has size 0; null source is a source of its own, last in order; an empty table gives an empty
result; a repeated doc_id keeps its rows, in mix() and in repeat(); documents of size 0 take 0 words; extra columns are ignored by targets() and
quotas() and kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 16
SEED = 20
#: A shard has about this many documents, whatever the size of its source.
SHARD_DOCS = 2000
#: Sources or shards up to this many are broadcast, after a count; more are joined by shuffling.
BROADCAST_ROWS = 50_000


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, docs, source_size, target): share of all words by weight, none above cap times its size.

    A source is capped if the common level (words for each unit of weight) is above its own cap / weight, so the capped
    ones are a prefix in order of that ratio; the level is then what the capped ones leave over for the rest.
    The rows are one a source; their number is that of the sources, not of the documents.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(cap))
    rank = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    upto = rank.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) * float(share) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    level = left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    settled = F.max(F.when(F.col("_free"), F.col("_level"))).over(everyone)  # further on in the order, levels only fall
    target = F.least("_cap", F.coalesce(settled, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "docs", "source_size", target.cast("double").alias("target"))


def apportion(parts: DataFrame, within: list[str], order: list[Column], weight: str, seats: str, total: str, quota: str) -> DataFrame:
    """Adds `quota`: `seats` seats of each group `within`, by highest quotients weight / (2a + 1), ties by `order`.

    total is the group's sum of weights.  With n parts, rounding shares off by at most n/2 seats in all, so a part's seats
    are within share * n / (2 * seats) + 2 of its exact share: those are the only quotients that have to be ranked, about 6 a part.
    """
    group = Window.partitionBy(*within)
    share = F.when(F.col(total) > 0, F.col(weight) / F.col(total) * F.col(seats)).otherwise(0.0)
    n = F.count(F.lit(1)).over(group)
    slack = (F.ceil(share * n / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2).cast("long")
    low = F.greatest(F.floor(share).cast("long") - slack, F.lit(0).cast("long"))
    parts = parts.withColumn("_low", low).withColumn("_high", F.floor(share).cast("long") + slack).withColumn("_id", F.struct(*order))
    rest = F.col(seats) - F.sum("_low").over(group)
    parts = parts.withColumn("_rest", rest)
    ranked = parts.select(*within, "_id", "_low", "_rest", F.col(weight).alias("_w"), F.explode(F.sequence("_low", "_high")).alias("_a"))
    best = Window.partitionBy(*within).orderBy(F.desc(F.col("_w") / (2 * F.col("_a") + 1)), "_id", "_a")
    won = ranked.filter("_w > 0").withColumn("_n", F.row_number().over(best)).filter("_n <= _rest").groupBy(*within, "_id").agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*(F.col(c).alias(f"_won_{c}") for c in within), F.col("_id").alias("_won_id"), "_won")
    match = F.col("_id") == F.col("_won_id")
    for c in within:
        match = match & (F.col(c) == F.col(f"_won_{c}"))
    out = parts.join(won, match, "left")
    return out.select(*(c for c in parts.columns if c[0] != "_"), (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(quota))


def _seeded(seed: int, *columns: str | Column) -> Column:
    """A hash from 0 to 2**60 - 1 that any engine with md5 can make."""
    text = F.md5(F.concat_ws(":", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and tie of docs: rows of one id are told apart by a hash of their texts."""
    return docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))


def _placed(rows: DataFrame, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """rows (doc_id, source, size, tie and others) with source_size, target and taken.  sizes: those four columns, stored.

    Rows stay whole from their shard's window on, so none has to be found again by its id.
    """
    per = targets(sizes, weights, share, cap)
    # A source id stands in for the (nullable) name in everything that follows.
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("shards", F.greatest(F.ceil(F.col("docs") / float(shard_docs)), F.lit(1)).cast("long")).withColumn("one", F.lit(1))
    per = per.withColumn("all_words", F.sum("target").over(Window.partitionBy()))
    per = per.withColumn("all_blocks", F.round(F.col("all_words") / float(block_words)).cast("long"))
    # Highest quotients of the targets: a capped source's quota is bounded by its target, as all quotas are near theirs.
    per = checkpoint(apportion(per, ["one"], [F.col("sid")], "target", "all_blocks", "all_words", "blocks"))
    known = bounded_broadcast(per.select(F.col("source").alias("_source"), "sid", "shards", "source_size", "target"), BROADCAST_ROWS)

    def sharded(of: DataFrame) -> DataFrame:
        return of.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(_seeded(seed + 1, "doc_id", "tie"), F.col("shards")))

    shards = sharded(sizes).groupBy("sid", "shard").agg(F.sum("size").alias("words"))
    shards = shards.join(bounded_broadcast(per.select("sid", "blocks", "source_size"), BROADCAST_ROWS), "sid")
    shards = apportion(shards, ["sid"], [F.col("shard")], "words", "blocks", "source_size", "quota")
    take = F.least(F.col("quota") * float(block_words), F.col("words") * float(cap)).cast("long")
    shards = shards.withColumn("_take", take).withColumn("passes", F.when(F.col("words") > 0, F.expr("_take div words")).otherwise(0)).withColumn("rest", F.when(F.col("words") > 0, F.col("_take") % F.col("words")).otherwise(0))
    start = F.pmod(_seeded(seed + 2, "sid", "shard"), F.greatest(F.ceil(F.col("words") / float(block_words)), F.lit(1)).cast("long")) * block_words
    shards = checkpoint(shards.select(F.col("sid").alias("_sid"), F.col("shard").alias("_shard"), "words", "passes", "rest", start.alias("start")))
    shards = bounded_broadcast(shards, BROADCAST_ROWS)
    ring = Window.partitionBy("sid", "shard").orderBy("_h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded(rows).withColumn("_h", _seeded(seed, "doc_id", "tie")).withColumn("end", F.sum("size").over(ring)).withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.join(shards, (F.col("sid") == F.col("_sid")) & (F.col("shard") == F.col("_shard")))
    overlap = lambda a, b: F.greatest(F.least(F.col("end"), b) - F.greatest(F.col("begin"), a), F.lit(0))
    stop = F.col("start") + F.col("rest")
    # The run may pass the ring's end: then it goes on at its beginning.
    taken = F.col("passes") * F.col("size") + overlap(F.col("start"), stop) + overlap(F.lit(0), stop - F.col("words"))
    return placed.select(*rows.columns, "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).  how: what _placed() can be told."""
    sizes = checkpoint(_measured(docs))
    return _placed(sizes, sizes, **how).select("doc_id", "size", "source_size", "target", "taken")


def repeat(docs: DataFrame, **how) -> DataFrame:
    """docs with what the mix takes of each: a row for each whole pass, the last one cut to its first taken words if it is not whole.

    Documents of which nothing is taken go, except those without words, of which nothing can be taken: they stay once.
    Repeated rows, and different rows of one id, are each taken as the mix says.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = _placed(_measured(docs, row), checkpoint(_measured(docs)), **how)
    out = out.filter((F.col("taken") > 0) | (F.col("size") == 0))
    passes = F.greatest(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))), F.lit(1)).cast("int")
    out = out.select("row", "size", "taken", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    # A place between words, after each: the parts before the cut, joined, are the text's beginning unchanged.
    parts = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(words < F.col("size"), F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    row = row.withField("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else row
    return out.select(row.alias("row")).select("row.*")
