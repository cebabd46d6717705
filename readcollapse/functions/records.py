"""Mates: records of one read in several files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint, stored


def mate_id(name: Column) -> Column:
    """A record's name up to the first white space, without one last 1, 2 or 3."""
    return F.regexp_replace(F.regexp_extract(name, r"^([^ \t]*)", 1), "[123]$", "")


def are_mates(names: Column) -> Column:
    """Whether all names of an array belong to one read; equal names are not taken apart."""
    return (F.size(F.array_distinct(names)) <= 1) | (F.size(F.array_distinct(F.transform(names, mate_id))) <= 1)


def mates_checked(mates: Column) -> Column:
    """mates; raises if their names differ."""
    names = F.transform(mates, lambda m: m["name"])
    return F.when(are_mates(names), mates).otherwise(F.raise_error(F.concat(F.lit("FASTQ files not in sync: "), F.array_join(names, ", "), F.lit(" are not mates."))))


def numbered(rows: DataFrame, *order: str, index: str = "rec_idx", keep: Sequence[str] | None = None, in_order: bool = False) -> DataFrame:
    """rows with their dense place (from 0) in the order given, and of their columns those to keep (all, if None).

    Rows are made once and stored, for cutting them into ranges looks at them twice.  Ranges are sorted in parallel, each row gets its range and its
    place there, and what comes before each range is summed over a row a range.  in_order: the result's partitions, and the rows in them, are in
    that order.
    """
    cut = stored(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    # The range in the high bits, the place in it in the lower 33.
    cut = cut.select(F.monotonically_increasing_id().alias("_at"), *(rows.columns if keep is None else keep))
    cut = checkpoint(cut) if in_order else stored(cut)
    part = F.shiftright("_at", 33)
    sizes = cut.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = cut.join(F.broadcast(before), part == F.col("_p"))  # a row a partition
    return placed.select((F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(index), *cut.columns[1:])


def zipped(left: DataFrame, right: DataFrame, index: str = "rec_idx") -> DataFrame:
    """Rows of both by place; the longer one's rest goes."""
    return left.join(right, index)
