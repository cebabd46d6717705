"""Similarity joins: pairs of keys within a distance, through equal segments.

A key is cut into d + 1 segments.  Two keys within d substitutions have a segment in common at the same place; within d edits,
a segment of the shorter one is found in the longer one, shifted by d at most.  So candidates come from a hash-partitioned
equi-join, and no pair of keys without a common segment is ever looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import hamming_distance


def _cut(length: Column, place: Column | int, parts: int) -> Column:
    """Where segment `place` of `parts` begins (from 0)."""
    return F.floor(length * place / parts).cast("int")


def _segment(text: Column, place: int, parts: int) -> Column:
    begin = _cut(F.length(text), place, parts)
    return F.substring(text, begin + 1, _cut(F.length(text), place + 1, parts) - begin)


def _own_segments(keys: DataFrame, parts: int, *columns: str) -> DataFrame:
    cuts = F.array(*(F.struct(F.lit(i).alias("i"), _segment(F.col("seq"), i, parts).alias("s")) for i in range(parts)))
    return keys.select(*columns, F.length("seq").alias("len"), F.explode(cuts).alias("c")).select(*columns, "len", "c.i", "c.s")


def _hamming(left: DataFrame, right: DataFrame, most: int, ordered: bool) -> DataFrame:
    """left (seq, n) and right (seq, n) within `most` substitutions: (a, an, b, bn).  Each pair comes once."""
    parts = most + 1
    x = _own_segments(left, parts, "seq", "n").select("len", "i", "s", F.col("seq").alias("a"), F.col("n").alias("an"))
    y = _own_segments(right, parts, "seq", "n").select("len", "i", "s", F.col("seq").alias("b"), F.col("n").alias("bn"))
    found = x.join(y, ["len", "i", "s"])
    if ordered:
        found = found.filter("a < b")
    # A pair counts at the first segment it has in common: nothing has to be made distinct afterwards.
    for k in range(parts - 1):
        found = found.filter((F.col("i") <= k) | (_segment(F.col("a"), k, parts) != _segment(F.col("b"), k, parts)))
    return found.filter(hamming_distance(F.col("a"), F.col("b")) <= most).select("a", "an", "b", "bn")


def _levenshtein(left: DataFrame, right: DataFrame, most: int, own: bool) -> DataFrame:
    """The shorter of two keys is left's, for which segments are made; right's substrings are looked up in them."""
    parts = most + 1
    x = _own_segments(left, parts, "seq", "n").select("len", "i", "s", F.col("seq").alias("a"), F.col("n").alias("an"))
    probe = right.select(F.col("seq").alias("b"), F.col("n").alias("bn"), F.explode(F.sequence(F.greatest(F.length("seq") - most, F.lit(0)), F.length("seq"))).alias("len"))
    probe = probe.select("b", "bn", "len", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i"))
    begin = _cut(F.col("len"), F.col("i"), parts)
    size = _cut(F.col("len"), F.col("i") + 1, parts) - begin
    low, high = F.greatest(begin - most, F.lit(0)), F.least(begin + most, F.length("b") - size)
    places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    texts = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("b"), p + 1, size)))
    probe = probe.select("b", "bn", "len", "i", F.explode(texts).alias("s"))
    found = x.join(probe, ["len", "i", "s"])
    if own:
        # Equal lengths meet from both sides; one of them is kept.
        found = found.filter((F.col("len") < F.length("b")) | (F.col("a") < F.col("b")))
    found = found.filter(F.levenshtein("a", "b", most) >= 0)
    return found.select("a", "an", "b", "bn").distinct()


def similarity_pairs(keys: DataFrame, most: int = 1, metric: str = "hamming") -> DataFrame:
    """(a, an, b, bn) with a < b, for all pairs of different keys (seq, n) within the distance."""
    if most < 0:
        raise ValueError("the distance must not be negative")
    if most == 0:
        return keys.select(F.col("seq").alias("a"), F.col("n").alias("an"), F.col("seq").alias("b"), F.col("n").alias("bn")).filter("false")
    if metric == "hamming":
        return _hamming(keys, keys, most, True)
    swap = F.col("a") > F.col("b")
    found = _levenshtein(keys, keys, most, True)
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select(pick("a", "b").alias("a"), pick("an", "bn").alias("an"), pick("b", "a").alias("b"), pick("bn", "an").alias("bn"))


def contains(keys: DataFrame, probes: DataFrame, most: int = 0, metric: str = "hamming") -> DataFrame:
    """probes (seq) with `found`: whether any key (seq) lies within the distance.  False for all if there are no keys."""
    if most < 0:
        raise ValueError("the distance must not be negative")
    asked = probes.select("seq").distinct()
    if most == 0:
        hits = asked.join(keys.select("seq"), "seq", "left_semi")
    else:
        one = F.lit(1).alias("n")
        ask, have = asked.select("seq", one), keys.select("seq").distinct().select("seq", one)
        if metric == "hamming":
            hits = _hamming(ask, have, most, False).select(F.col("a").alias("seq"))
        else:
            # Either side may be the shorter one.
            hits = _levenshtein(ask, have, most, False).select(F.col("a").alias("seq")).union(_levenshtein(have, ask, most, False).select(F.col("b").alias("seq")))
        hits = hits.distinct()
    hits = hits.select(F.col("seq").alias("_hit"))
    return probes.join(hits, F.col("seq") == F.col("_hit"), "left").select(*probes.columns, F.col("_hit").isNotNull().alias("found"))
