"""Average error rates of Phred strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..options import DEFAULT_OFFSET
from .slices import once

#: Probability of an error for each score.  Values of Python's power: Java's differs in the last place for some scores.
ERROR_RATES = [10 ** -(score / 10) for score in range(128)]


def _checked(quality: Column, offset: int) -> Column:
    if not 0 <= offset <= 126:
        raise ValueError("the offset must be from 0 to 126")
    plain = quality.isNull() | quality.rlike(r"\A[\x{%x}-\x7e]*\z" % offset)
    ascii_only = F.octet_length(quality) == F.length(quality)
    message = F.when(ascii_only, F.concat(F.lit("outside of valid phred range: "), quality)).otherwise(F.concat(F.lit("must be ASCII encoded: "), quality))
    return F.when(plain, quality).otherwise(F.raise_error(message).cast("string"))


def checked_qualities(quality: Column, offset: int = DEFAULT_OFFSET) -> Column:
    """quality; characters that are not ASCII or not from the offset to 126 raise."""
    return once(quality, lambda q: _checked(q, offset))


def _rate(quality: Column, offset: int) -> Column:
    table = F.array(*map(F.lit, ERROR_RATES))
    rates = F.transform(F.split(quality, ""), lambda c: F.get(table, F.ascii(c) - offset))
    total = F.aggregate(rates, F.lit(0.0), lambda total, rate: total + rate)
    return F.when(F.length(quality) == 0, F.lit(float("nan"))).otherwise(total / F.length(quality))


def average_error_rate(quality: Column, offset: int = DEFAULT_OFFSET, check: bool = True) -> Column:
    """Sum of error rates from left to right, divided by the length; NaN for an empty string, null for null."""
    return once(quality, lambda q: once(_checked(q, offset), lambda c: _rate(c, offset)) if check else _rate(q, offset))


def _summed(strings: pa.Array, offset: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of error rates and length of each string (0 and 0 for null): one addition for each position in all strings, so sums run from left to right."""
    s = pc.fill_null(strings.cast(pa.large_string()), "")
    cuts = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1] if len(s) else np.zeros(1, np.int64)
    size, begin = np.diff(cuts), cuts[:-1]
    codes = np.frombuffer(s.buffers()[2] or b"", np.uint8)
    mine = codes[cuts[0] : cuts[-1]]
    if len(mine) and (mine.min() < offset or mine.max() > 126):
        wrong = int(np.flatnonzero((mine < offset) | (mine > 126))[0]) + cuts[0]
        text = s[int(np.searchsorted(cuts, wrong, "right")) - 1].as_py()
        raise ValueError(("outside of valid phred range: " if text.isascii() else "must be ASCII encoded: ") + text)
    total, longest = np.zeros(len(s)), int(size.max(initial=0))
    if longest and (size == longest).all():
        for column in mine.reshape(-1, longest).T:
            total += table[column]
        return total, size
    order = np.argsort(-size, kind="stable")
    for place in range(longest):
        rows = order[: np.searchsorted(-size[order], -place, "left")]
        total[rows] += table[codes[begin[rows] + place]]
    return total, size


def _table(offset: int) -> np.ndarray:
    return np.array([*[np.nan] * offset, *ERROR_RATES])


def average_error_rate_arrow(offset: int = DEFAULT_OFFSET):
    """The same as an Arrow function on batches, with sums from left to right too."""

    table, summed = _table(offset), _summed

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            total, size = summed(s, offset, table)
            with np.errstate(invalid="ignore"):
                yield pa.array(total / size, mask=s.is_null().to_numpy(zero_copy_only=False), from_pandas=False)

    return rate


def passes_arrow(most: float, offset: int = DEFAULT_OFFSET) -> Callable[[pa.Array], np.ndarray]:
    """`passes` for Arrow arrays, with the same sums and checks."""
    table = _table(offset)

    def judge(qualities: pa.Array) -> np.ndarray:
        total, size = _summed(qualities, offset, table)
        # Null and empty strings have no rate, and are kept.
        return (size == 0) | ~(total / np.maximum(size, 1) > most)

    return judge


def passes(quality: Column, most: float, offset: int = DEFAULT_OFFSET) -> Column:
    """Whether a row is kept: its rate is not above `most`.  Without qualities there is no rate, and the row is kept."""
    # NaN is above any number in Spark, so empty strings are told apart first.
    return once(quality, lambda q: q.isNull() | (F.length(q) == 0) | ~(average_error_rate(q, offset) > most))


def quality_filter(reads: DataFrame, quality: Column, most: float, offset: int = DEFAULT_OFFSET, observed: Observation | None = None) -> DataFrame:
    """Rows whose rate is at most `most`; all rows, unchecked, if `most` is 1 or more.  `observed` gets total and discarded."""
    if most >= 1.0:
        return reads.observe(observed, F.count(F.lit(1)).alias("total"), F.lit(0).alias("discarded")) if observed else reads
    rows = reads.withColumn("_kept", passes(quality, most, offset))
    if observed:
        rows = rows.observe(observed, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_kept")).alias("discarded"))
    return rows.filter("_kept").drop("_kept")
