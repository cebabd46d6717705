"""Counting keys, clusters of keys, and representatives of clusters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .combine import counted_records
from .components import components


def count_keys(reads: DataFrame, key: Column) -> DataFrame:
    """(seq, n): every key and how often it occurs."""
    return reads.groupBy(key.alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def delete_keys(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """keys (seq, n) without those of gone (seq), all their copies."""
    return keys.join(gone.select("seq"), "seq", "left_anti")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Links from and to: (a, an, b, bn) and its mirror."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))


def clusters(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, n, cluster_id): components of the pairs, each named by its smallest key."""
    found = components(pairs.select("a", "b"))
    return keys.join(found, F.col("seq") == F.col("node"), "left").select("seq", "n", F.coalesce("component", "seq").alias("cluster_id"))


def highest_count(clustered: DataFrame) -> DataFrame:
    """(seq) of each cluster's most frequent key; of equal ones the greatest."""
    return clustered.groupBy("cluster_id").agg(F.max(F.struct("n", "seq")).alias("top")).select("top.seq")


#: Rounds after which small components are settled by a task each, and how many links those may have.
ROUNDS = 16
TASK_LINKS = 1 << 20


def _greedy(links: pd.DataFrame) -> pd.DataFrame:
    """(seq) of the keys of a component's links that are kept, from the highest rank on."""
    near = links.groupby("a")["b"].agg(list).to_dict()
    order = links.drop_duplicates("a").sort_values(["an", "a"], ascending=False)["a"]
    kept, gone = [], set()
    for key in order:
        if key not in gone:
            kept.append(key)
            gone.update(near[key])
    return pd.DataFrame({"seq": pd.Series(kept, dtype=object)})


def adjacency(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq) of the keys kept by taking the highest-ranked one, dropping its neighbours, and so on.

    By rounds: an open key that outranks all its open neighbours is kept, and its neighbours are dropped.  That gives the
    same set as one key at a time; ranks are (n, seq).  Only keys with neighbours go through rounds.  A chain of falling ranks takes a round for
    every other key: after ROUNDS rounds, the components of what is open that have TASK_LINKS links at most are
    settled by one task each, one key at a time; rounds go on for larger ones.
    """
    links, rounds = checkpoint(both_ways(pairs)), 0
    lonely = keys.join(links.select(F.col("a").alias("seq")).distinct(), "seq", "left_anti").select("seq")
    kept = lonely
    while not links.isEmpty():
        beaten = F.max((F.col("bn") > F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("b") > F.col("a"))))
        top = checkpoint(links.groupBy("a").agg(beaten.alias("beaten")).filter("not beaten").select(F.col("a").alias("_top")))
        gone = checkpoint(links.join(top, F.col("a") == F.col("_top"), "left_semi").select(F.col("b").alias("_gone")).union(top.select("_top")).distinct())
        kept = kept.union(top.select("_top"))
        # Keys that neither won nor fell but whose neighbours are all gone are kept.
        rest = links.join(gone, F.col("a") == F.col("_gone"), "left_anti")
        open_before = rest.select("a").distinct()
        links = checkpoint(rest.join(gone, F.col("b") == F.col("_gone"), "left_anti"))
        kept = checkpoint(kept.union(open_before.join(links.select("a").distinct(), "a", "left_anti")))
        rounds += 1
        if rounds % ROUNDS == 0:
            named = checkpoint(links.join(components(links.select("a", "b")), F.col("a") == F.col("node")).select(*links.columns, "component"))
            small = named.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") <= TASK_LINKS).select(F.col("component").alias("_c"))
            settled = named.join(small, F.col("component") == F.col("_c"), "left_semi").groupBy("component").applyInPandas(_greedy, "seq string")
            kept = checkpoint(kept.union(settled))
            links = checkpoint(named.join(small, F.col("component") == F.col("_c"), "left_anti").select(*links.columns))
    return kept.select(F.col(kept.columns[0]).alias("seq"))


def directional(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq) of the keys that no chain of links from a higher-ranked key absorbs; a link leads from a to b if an >= 2 bn - 1.

    For counts of 2 or more a key stays if it has no such link into it.  Keys of count 1 absorb each other both ways: of each of
    their components the greatest stays, unless a member has a neighbour of count 2 or more.
    """
    links = checkpoint(both_ways(pairs))
    absorbed = links.filter("bn >= 2 and an >= 2 * bn - 1").select(F.col("b").alias("seq"))
    strong = keys.filter("n >= 2").join(absorbed, "seq", "left_anti").select("seq")
    near = links.filter("bn = 1 and an >= 2").select(F.col("b").alias("_near")).distinct()
    single = keys.filter("n = 1").select("seq")
    groups = components(links.filter("an = 1 and bn = 1 and a < b").select("a", "b"))
    single = single.join(groups, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("component", "seq").alias("group"))
    single = single.join(near, F.col("seq") == F.col("_near"), "left")
    weak = single.groupBy("group").agg(F.max("seq").alias("seq"), F.count("_near").alias("near")).filter("near = 0").select("seq")
    return strong.union(weak)


def custom(clustered: DataFrame, choose: Callable) -> DataFrame:
    """(seq) by a function of one's own: it gets each cluster as a pandas frame (seq, n, cluster_id) and returns a frame of seq.

    A cluster has to fit in a task's memory here; the built-in methods have no such bound.
    """
    return clustered.groupBy("cluster_id").applyInPandas(lambda frame: choose(frame)[["seq"]], "seq string")


def survivors(keys: DataFrame, pairs: DataFrame, method: str = "directional") -> DataFrame:
    if method == "directional":
        return directional(keys, pairs)
    if method == "adjacency":
        return adjacency(keys, pairs)
    if method == "highest_count":
        return highest_count(clusters(keys, pairs))
    raise ValueError(f"unknown method {method!r}")


def taken(counted: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """The first rows of the keys kept (seq), of counted (seq, n, r)."""
    return counted.join(kept.select(F.col("seq").alias("_kept")), F.col("seq").eqNullSafe(F.col("_kept")), "left_semi").select(*(F.col("r")[c].alias(c) for c in names))


def first_records(reads: DataFrame, kept: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of reads (in order) for each key kept, whatever its quality."""
    return taken(counted_records(reads, F.lit(True), key, order), kept, reads.columns)
