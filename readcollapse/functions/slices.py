"""Slices of strings and keys made of them, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f names it.

    A filter's condition is pushed below projections with every name in it replaced by the expression it stands for; here the expression
    stands in the condition once, and f names a lambda's variable.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bound(x: int | None, length: Column, low: Column, high: Column, default: Column) -> Column:
    if x is None:
        return default
    return F.greatest(length + x, low) if x < 0 else F.least(F.lit(x), high)


def slice_text(text: Column, part: slice) -> Column:
    """text[part] with Python's meaning of negative and open bounds and of steps."""
    step = 1 if part.step is None else part.step
    if step == 0:
        raise ValueError("a slice's step must not be 0")
    length = F.length(text)
    low, high = (F.lit(0), length) if step > 0 else (F.lit(-1), length - 1)
    start = _bound(part.start, length, low, high, low if step > 0 else high)
    stop = _bound(part.stop, length, low, high, high if step > 0 else low)
    if step == 1:
        if part.start in (None, 0) and part.stop is None:
            return text
        return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))
    if step == -1 and part.start is None and part.stop is None:
        return F.reverse(text)
    # sequence() would count down for an empty range, so that case is kept out.
    count = F.floor((stop - start + (step - (1 if step > 0 else -1))) / F.lit(step)).cast("int")
    places = F.sequence(F.lit(0), count - 1)
    taken = F.array_join(F.transform(places, lambda i: F.substring(text, start + i * step + 1, F.lit(1))), "")
    return F.when(text.isNull(), None).when(count > 0, taken).otherwise("")


def key(texts: Sequence[Column], parts: Sequence[slice] | None = None) -> Column:
    """The sliced texts, one after another without a separator."""
    return F.concat(*(slice_text(t, p) for t, p in zip(texts, parts or [slice(None)] * len(texts), strict=True)))


def quality_key(qualities: Sequence[Column], parts: Sequence[slice] | None = None) -> Column:
    """The sliced qualities, one after another.  Missing ones are left out before slices are paired, so the i-th slice
    goes with the i-th quality that is there."""
    if parts is None:
        return F.concat_ws("", *qualities)
    there = F.filter(F.array(*qualities), lambda q: q.isNotNull())
    return F.concat_ws("", *(F.coalesce(slice_text(F.get(there, i), p), F.lit("")) for i, p in enumerate(parts)))


def is_ascii(text: Column) -> Column:
    return once(text, lambda t: F.octet_length(t) == F.length(t))


def checked_key(text: Column) -> Column:
    """text; a key that is not ASCII raises."""
    refuse = lambda t: F.raise_error(F.concat(F.lit("keys must be ASCII encoded: "), t)).cast("string")
    return once(text, lambda t: F.when(t.isNull() | is_ascii(t), t).otherwise(refuse(t)))
