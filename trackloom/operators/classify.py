"""Static and dynamic attributes, and the order of entities in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.ordering import ordinals
from trackloom.functions.scalar import cell, mask_bits, morton, quantize, sort_key


def minmax(df: DataFrame, channels: list[str]) -> DataFrame:
    """(entity, lo_c, hi_c, v0_c): per entity the extremes over time and the first frame's values."""
    return df.groupBy("entity").agg(*(f for c in channels for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.min_by(c, "frame").alias(f"v0_{c}"))))


def aabb(ranges: DataFrame, channels: list[str]) -> DataFrame:
    return ranges.agg(*(f for c in channels for f in (F.min(f"lo_{c}").alias(f"min_{c}"), F.max(f"hi_{c}").alias(f"max_{c}"))))


#: Slack of the static test for floats.
SLACK = 1e-9


def static_float(ranges: DataFrame, channels: list[str], eps: float, pitch: float, name: str = "static") -> DataFrame:
    """With `name` and base_c: the grid point nearest an entity's mid-range, if all its channels stay within eps of theirs, else the first frame's."""
    cand = {c: quantize((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2, pitch) for c in channels}
    fits = [(F.col(f"hi_{c}") - eps - SLACK <= cand[c] * pitch) & (cand[c] * pitch <= F.col(f"lo_{c}") + eps + SLACK) for c in channels]
    return _classified(ranges, channels, name, fits, cand, {c: quantize(F.col(f"v0_{c}"), pitch) for c in channels})


def static_int(ranges: DataFrame, channels: list[str], bound: int, name: str = "static") -> DataFrame:
    """The same for integers; the candidate is the floor of the mid-range."""
    cand = {c: F.shiftright(F.col(f"lo_{c}") + F.col(f"hi_{c}"), 1).cast("bigint") for c in channels}
    fits = [(F.col(f"hi_{c}") - bound <= cand[c]) & (cand[c] <= F.col(f"lo_{c}") + bound) for c in channels]
    return _classified(ranges, channels, name, fits, cand, {c: F.col(f"v0_{c}").cast("bigint") for c in channels})


def _classified(ranges: DataFrame, channels, name, fits: list[Column], cand, first) -> DataFrame:
    every = fits[0]
    for f in fits[1:]:
        every = every & f
    return ranges.withColumn(name, every).select("*", *(F.when(F.col(name), cand[c]).otherwise(first[c]).alias(f"base_{c}") for c in channels))


def ordered(meta: DataFrame, static: list[str], position: list[str], least: list[float], step) -> DataFrame:
    """meta with mask, key and ord: by mask, then along a space-filling curve of the first frame, ties by entity."""
    mask = mask_bits(*(~F.col(s) for s in static))
    code = morton(*(cell(F.col(p), F.lit(m), step) for p, m in zip(position, least)))
    return ordinals(meta.withColumn("mask", mask).withColumn("key", sort_key(F.col("mask"), code)), "key", "entity")


def groups(meta: DataFrame) -> DataFrame:
    """The runs of equal masks in file order: at most 32 rows."""
    return meta.groupBy("mask").agg(F.count("*").alias("n"))


def static_fractions(meta: DataFrame, static: list[str]) -> DataFrame:
    return meta.agg(*(F.round(F.avg(F.col(s).cast("int")), 6).alias(f"frac_{s}") for s in static), *(F.count_if(~F.col(s)).alias(f"dyn_{s}") for s in static))


def bitmap(meta: DataFrame, flag: str, ordinal: str = "ord") -> DataFrame:
    """(byte_no, byte): flags in file order, eight a byte, the first in the highest bit."""
    bit = F.when(F.col(flag), F.pow(F.lit(2), 7 - F.col(ordinal) % 8)).otherwise(0)
    return meta.groupBy(F.floor(F.col(ordinal) / 8).cast("bigint").alias("byte_no")).agg(F.sum(bit).cast("bigint").alias("byte"))


def unbitmap(packed: DataFrame, n: int) -> DataFrame:
    """(ord, flag): the inverse of bitmap."""
    bits = packed.select("byte", F.explode(F.sequence(F.col("byte_no") * 8, F.col("byte_no") * 8 + 7)).alias("ord"))
    return bits.where(F.col("ord") < n).select("ord", (F.floor(F.col("byte") / F.pow(F.lit(2), 7 - F.col("ord") % 8)) % 2 == 1).alias("flag"))
