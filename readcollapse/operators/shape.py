"""What a prefix tree of the keys would look like: nodes by layer, and their memory.  No tree is built.

A prefix is a node if it is empty or its parent is shared by several keys; a node of one key is a leaf that holds the rest
of it, any other has room for children up to the letter that stands last in the alphabet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters in front of all others, which follow by their code.
ALPHABET = "ACGTN"
NODE_BYTES = 8
CHILD_BYTES = 8


def check_alphabet(letters: str) -> str:
    if not letters.isascii():
        raise ValueError("an alphabet must be ASCII")
    for c in letters:
        if letters.count(c) > 1:
            raise ValueError(f"{c} was repeated")
    if len(letters) > 254:
        raise ValueError("an alphabet has at most 254 letters")
    return letters


def letters(keys: DataFrame, known: str = "") -> DataFrame:
    """(letter, place): the known letters in order, then what else the keys hold, by code."""
    check_alphabet(known)
    found = keys.select(F.explode(F.array_distinct(F.split("seq", ""))).alias("letter")).filter("letter <> ''").distinct()
    if known:
        given = found.sparkSession.createDataFrame([(c,) for c in known], "letter string")
        found = found.union(given).distinct()
    at = F.instr(F.lit(known), F.col("letter")) if known else F.lit(0)
    # A row a letter: an ASCII alphabet has 128 at most.
    rows = F.array_sort(F.collect_list(F.struct(F.when(at > 0, at).otherwise(F.lit(1000) + F.ascii("letter")).alias("o"), "letter")))
    return found.agg(rows.alias("all")).select(F.posexplode("all").alias("p", "x")).select(F.col("x.letter").alias("letter"), F.col("p").cast("int").alias("place"))


def nodes(keys: DataFrame, known: str = ALPHABET) -> DataFrame:
    """(layer, capacity, suffix): a row a node; capacity 0 is a leaf, with the length of its suffix."""
    order = "".join(r["letter"] for r in sorted(letters(keys, known).collect(), key=lambda r: r["place"]))  # an alphabet: 128 rows at most
    distinct = keys.select("seq").distinct()
    grown = distinct.select("seq", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("layer"))
    grown = grown.select("layer", F.substring(F.col("seq"), F.lit(1), F.col("layer")).alias("prefix"), F.length("seq").alias("size"), F.instr(F.lit(order), F.substring(F.col("seq"), F.col("layer") + 1, F.lit(1))).alias("next"))
    per = grown.groupBy("layer", "prefix").agg(F.count(F.lit(1)).alias("m"), F.max("next").alias("capacity"), F.max("size").alias("size"))
    shared = per.filter("m >= 2").select((F.col("layer") + 1).alias("_layer"), F.col("prefix").alias("_parent"))
    parent = F.substring(F.col("prefix"), F.lit(1), F.greatest(F.col("layer") - 1, F.lit(0)))
    below = per.filter("layer > 0").join(shared, (F.col("layer") == F.col("_layer")) & (parent == F.col("_parent")), "left_semi")
    real = per.filter("layer = 0").union(below)
    leaf = F.col("m") == 1
    return real.select("layer", F.when(leaf, 0).otherwise(F.col("capacity")).alias("capacity"), F.when(leaf, F.col("size") - F.col("layer")).otherwise(0).alias("suffix"))


def shape(keys: DataFrame, known: str = ALPHABET) -> DataFrame:
    """(layer, capacity, nodes, bytes)."""
    size = F.col("capacity") * CHILD_BYTES + NODE_BYTES + F.col("suffix")
    return nodes(keys, known).groupBy("layer", "capacity").agg(F.count(F.lit(1)).alias("nodes"), F.sum(size).cast("long").alias("bytes"))


def memory(keys: DataFrame, known: str = ALPHABET) -> DataFrame:
    """(node_bytes, suffix_bytes, total_bytes) of the whole tree."""
    own = F.sum(F.col("nodes") * (F.col("capacity") * CHILD_BYTES + NODE_BYTES))
    return shape(keys, known).agg(F.coalesce(own, F.lit(0)).cast("long").alias("node_bytes"), F.coalesce(F.sum("bytes") - own, F.lit(0)).cast("long").alias("suffix_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def report(keys: DataFrame, known: str = ALPHABET) -> str:
    """A table of nodes by layer and capacity, with totals and memory.  A layer has a row, so the driver gets few."""
    rows = shape(keys, known).collect()
    width = max([r["capacity"] for r in rows], default=0)
    table: dict[int, list[int]] = {}
    for r in rows:
        table.setdefault(r["layer"], [0] * (width + 1))[r["capacity"]] += r["nodes"]
    lines = [[str(k), *v, sum(v)] for k, v in sorted(table.items())]
    lines.append(["all", *(sum(x[i] for x in lines) for i in range(1, width + 3))])
    head = f"{'depth':>10}{'leaves':>10}" + "".join(f"{f'room {i}':>10}" for i in range(1, width + 1)) + f"{'nodes':>10}"
    total = sum(r["bytes"] for r in rows)
    node = sum(r["nodes"] * (NODE_BYTES + CHILD_BYTES * r["capacity"]) for r in rows)
    sizes = [f"{name}: {value / 1024**3:.2} GiB" for name, value in (("nodes", node), ("suffixes", total - node), ("nodes and suffixes", total))]
    return "\n".join([head, *("".join(f"{x:>10}" for x in line) for line in lines), *sizes]) + "\n"
