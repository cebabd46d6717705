"""First rows and counts of keys, combined by each task with Arrow before anything is sorted or moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Rows, or bytes of rows, that a task gathers before it combines them, and bytes of combined rows beyond which it hands them on.
GATHER_ROWS, GATHER_BYTES, HELD_BYTES = 1 << 16, 1 << 26, 1 << 26

_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def _ordered_alike(kind: T.DataType) -> bool:
    """Whether Arrow orders values of a type as Spark does.  Floating-point numbers (NaN, signed zeros) and collations are not."""
    return kind == T.StringType() or isinstance(kind, _PLAIN)


def _moves(kind: T.DataType) -> bool:
    """Whether values of a type move to Arrow and back unchanged."""
    if isinstance(kind, T.StructType):
        return len(kind) > 0 and all(_moves(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _moves(kind.elementType)
    return isinstance(kind, (T.StringType, T.FloatType, T.DoubleType, *_PLAIN))


def combinable(rows: DataFrame) -> bool:
    """Whether rows (seq, _place and more) can be combined with Arrow: all moves there and back, places are ordered alike."""
    key, place = rows.schema["seq"].dataType, rows.schema["_place"].dataType
    places = [f.dataType for f in place] if isinstance(place, T.StructType) else [place]
    return key == T.StringType() and bool(places) and all(map(_ordered_alike, places)) and all(_moves(f.dataType) for f in rows.schema)


def _sort_keys(places: pa.Array) -> list[pa.Array]:
    """Arrays whose order (nulls first) is that of the places: those that are null come last, null fields of a struct first."""
    fields = [pc.struct_field(places, i) for i in range(places.type.num_fields)] if pa.types.is_struct(places.type) else [places]
    return [places.is_null(), *fields] if places.null_count else fields


def _first_rows(table: pa.Table) -> pa.Table:
    """A row a key (seq): n and m summed, the rest of the first row by _place."""
    table = table.combine_chunks()
    if not len(table):
        return table
    whole = lambda name: table[name].chunk(0)
    codes = whole("seq").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    by = _sort_keys(whole("_place"))
    if len(by) == 1:
        order = pc.array_sort_indices(by[0], null_placement="at_start").to_numpy()
    else:
        names = [f"p{i}" for i in range(len(by))]
        order = pc.sort_indices(pa.table(by, names), sort_keys=[(x, "ascending") for x in names], null_placement="at_start").to_numpy()
    back = order[::-1].astype(np.int64)
    first = np.empty(int(codes.max()) + 1, np.int64)
    first[codes[back]] = back  # the last one written stays: the first in order
    sums = {x: pa.array(np.bincount(codes, whole(x).to_numpy()).astype(np.int64)) for x in ("n", "m")}
    out = table.take(pa.array(first))
    for x, values in sums.items():
        out = out.set_column(out.schema.get_field_index(x), table.schema.field(x), values)
    return out


def _rivals(held: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """held with the counts of the rows that are no rivals of its own, and the other rows: of keys it has not, or of earlier places.

    Where places are one column without nulls; else all rows are rivals.
    """
    place, best = rows["_place"].combine_chunks(), held["_place"].combine_chunks()
    if pa.types.is_struct(place.type) or place.null_count or best.null_count or not len(held):
        return held, rows
    at = pc.index_in(rows["seq"].combine_chunks(), value_set=held["seq"].combine_chunks())
    beaten = pc.fill_null(pc.greater_equal(place, best.take(at)), False)
    where = at.filter(beaten).to_numpy(zero_copy_only=False)
    for x in ("n", "m"):
        more = np.bincount(where, rows[x].filter(beaten).to_numpy(), len(held)).astype(np.int64)
        held = held.set_column(held.schema.get_field_index(x), held.schema.field(x), pa.array(held[x].to_numpy() + more))
    return held, rows.filter(pc.invert(beaten))


def _folded(batches: Iterator[pa.RecordBatch], judge: Callable[[pa.Array], np.ndarray] | None, most_rows: int, most_bytes: int, most_held: int) -> Iterator[pa.RecordBatch]:
    held, fresh, rows, size = None, [], 0, 0

    def fold(held: pa.Table | None) -> pa.Table:
        new = pa.Table.from_batches(fresh)
        if held is not None:
            held, new = _rivals(held, new)
            new = pa.concat_tables([held, new])
        return _first_rows(new)

    for batch in batches:
        if not len(batch):
            continue
        asked = batch.column("_counts")
        counts = judge(asked) if judge else pc.fill_null(asked, False).to_numpy(zero_copy_only=False)
        names = [x for x in batch.schema.names if x != "_counts"]
        batch = pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(counts.astype(np.int64)), pa.array(np.ones(len(batch), np.int64))], [*names, "n", "m"])
        fresh.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        # As many rows as are held, so that folding costs no more than gathering.
        if rows >= max(most_rows, 0 if held is None else len(held)) or size >= most_bytes:
            held, fresh, rows, size = fold(held), [], 0, 0
            if held.nbytes >= most_held:
                yield from held.to_batches()
                held = None
    if fresh:
        held = fold(held)
    if held is not None:
        yield from held.to_batches()


def combined(rows: DataFrame, judge: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """rows (seq, _counts, _place and more) with n and m for _counts: a row a key and task, or a few where keys are many.

    n: rows that count, by _counts, or by what judge makes of it; m: all rows.
    """
    ship(rows.sparkSession)
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "_counts"]).add("n", "long").add("m", "long")
    bounds = GATHER_ROWS, GATHER_BYTES, HELD_BYTES
    return rows.mapInArrow(lambda batches: _folded(batches, judge, *bounds), kept)


def counted_records(reads: DataFrame, counts: Column, key: Column, order: Column, judged: tuple[Column, Callable[[pa.Array], np.ndarray]] | None = None) -> DataFrame:
    """(seq, n, m, r): every key, how many of its reads count, how many it has, and the first of all its rows (in order), in one pass over reads.

    First rows are combined where the reads are, so a key that very many reads have is no more work than another, and of each only a few rows
    a task are sorted and moved.  Places may be equal; one of those rows is taken.

    judged: a column, and a function that makes of its Arrow array what counts would be, at less cost.
    """
    # Columns move one by one: Spark sizes a struct of them anew with every row.
    flat = [F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(reads.columns)]
    base = [key.alias("seq"), order.alias("_place"), *flat]
    # A place that is null comes last, and is none to min_by by itself.
    row = F.struct(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(reads.columns)))
    first = F.min_by(row, F.struct(F.col("_place").isNull(), "_place")).alias("r")
    if combinable(reads.select(*base)):
        asked, judge = judged or (counts, None)
        some = combined(reads.select(*base, asked.alias("_counts")), judge)
        return some.groupBy("seq").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), first)
    return reads.select(*base, counts.alias("_counts")).groupBy("seq").agg(F.count_if("_counts").alias("n"), F.count(F.lit(1)).alias("m"), first)
