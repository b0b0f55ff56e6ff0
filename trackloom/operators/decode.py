"""Back from bins to values, overlaying static bases, and the proof that bounds hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import clamp8, clamp_rot

#: Slack of the final check, floats only.
VERIFY_SLACK = 1e-6


def dequantize(kind: str, b: Column, step: float) -> Column:
    """As a decoder shows it: levels clamped, scales out of their logarithm."""
    v = b * step
    return {"pos": v, "scale": F.exp(v), "rgb": clamp8(v), "alpha": clamp8(v), "rot": clamp_rot(v)}[kind]


def overlay(base: DataFrame, dynamic: DataFrame, frames: DataFrame, channels: list[str], pitch, step) -> DataFrame:
    """(entity, frame, value_c): dynamic bins where there are some, else the static base. `frames` has (entity, frame), the frames of each entity, or only
    (frame), a row a frame; then every entity is shown in all of them, or in its own f0 .. f1 if the base has these."""
    if "entity" in frames.columns:
        every = base.join(frames, "entity")
    else:
        every = base.join(F.broadcast(frames), F.col("frame").between(F.col("f0"), F.col("f1"))) if "f0" in base.columns else base.crossJoin(F.broadcast(frames))
    d = dynamic.select("entity", "frame", *(F.col(f"bin_{c}").alias(f"_d_{c}") for c in channels))
    return every.join(d, ["entity", "frame"], "left").select("entity", "frame", *(F.coalesce(F.col(f"_d_{c}") * step, F.col(f"base_{c}") * pitch).alias(f"value_{c}") for c in channels))


def max_error(reference: DataFrame, decoded: DataFrame, channels: list[tuple[str, str]], bound: float, integer: bool) -> DataFrame:
    """(rows, max_err, ok): the greatest difference of (reference, decoded) channels by (entity, frame); values are not clamped here."""
    both = reference.join(decoded, ["entity", "frame"])
    worst = F.greatest(*(F.abs(F.col(a) - F.col(b)) for a, b in channels)) if len(channels) > 1 else F.abs(F.col(channels[0][0]) - F.col(channels[0][1]))
    slack = 0 if integer else VERIFY_SLACK
    return both.agg(F.count("*").alias("rows"), F.round(F.max(worst.cast("double")), 6).alias("max_err")).withColumn("ok", F.col("max_err") <= bound + slack)


def require_complete(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """`wanted` joined to `found`; a missing stream stops the job."""
    hit = found.withColumn("_there", F.lit(True))
    out = wanted.join(hit, keys, "left")
    return out.withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), "a stream is missing")).where("_ok is null").drop("_ok", "_there")
