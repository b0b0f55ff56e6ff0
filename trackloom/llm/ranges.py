"""Sampled splitters, with DataFrame functions only: which of a sorted list of splitters a row's key follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longs(values) -> Column:
    """A literal array of longs; the text form keeps the plan small and is folded to a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_of(key: Column, tie: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many of the sorted (key, tie) splitters are at or below a row's (key, tie): a binary search in one expression."""
    if not splitters:
        return F.lit(0)
    keys, ties = longs([k for k, _ in splitters]), longs([t for _, t in splitters])
    step = 1 << (len(splitters).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1

    def further(at, s):
        to = at + s
        k = F.get(keys, to - 1)
        below = (k < key) | ((k == key) & (F.get(ties, to - 1) <= tie))
        return F.when((to <= len(splitters)) & below, to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
