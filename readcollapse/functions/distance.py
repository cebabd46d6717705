"""Distances of strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of places that differ; null for strings of unequal length."""
    apart = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x)
    return F.when(F.length(a) == F.length(b), F.size(apart))


def within_hamming(a: Column, b: Column, most: int) -> Column:
    """False for strings of unequal length."""
    if most == 0:
        return a == b
    return (F.length(a) == F.length(b)) & (F.coalesce(hamming_distance(a, b), F.lit(most + 1)) <= most)


def within_levenshtein(a: Column, b: Column, most: int) -> Column:
    # With a threshold the function gives -1 beyond it, and stops early.
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, most) >= 0)


def within_distance(a: Column, b: Column, most: int, metric: str = "hamming") -> Column:
    if most < 0:
        raise ValueError("the distance must not be negative")
    if metric not in ("hamming", "levenshtein"):
        raise ValueError(f"unknown metric {metric!r}")
    return (within_hamming if metric == "hamming" else within_levenshtein)(a, b, most)
