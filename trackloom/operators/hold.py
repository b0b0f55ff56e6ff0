"""Deadband hold: a bin stays until the signal leaves its bound on any channel; then all channels are quantized anew.

Where the bound is half the step (the codec's own setting) holding gives the same bins as quantizing each value by itself, so that is the default and needs no
order. A wider bound is a true fold over an entity's frames; `hold` does it with built-in expressions for short tracks, `hold_buckets`
in Arrow batches, many entities at a time, for large scenes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import quantize, quantize_int


def stateless(df: DataFrame, channels: list[str], step, integer: bool) -> DataFrame:
    """(entity, frame, bin_c)."""
    of = (lambda c: quantize_int(F.col(c), step)) if integer else (lambda c: quantize(F.col(c), step))
    return df.select("entity", "frame", *(of(c).alias(f"bin_{c}") for c in channels))


def hold(df: DataFrame, channels: list[str], step, bound, integer: bool) -> DataFrame:
    """(entity, frame, bin_c), by an aggregate over each entity's sorted frames."""
    kind = "bigint" if integer else "double"
    row = F.struct("frame", F.array(*(F.col(c).cast(kind) for c in channels)).alias("v"))
    seq = df.groupBy("entity").agg(F.array_sort(F.collect_list(row)).alias("seq"))
    start = F.array().cast("array<struct<frame:bigint,b:array<bigint>>>")
    fresh = (lambda x: quantize_int(x, step)) if integer else (lambda x: quantize(x, step))

    def fold(done, r):
        last = F.element_at(done, -1)["b"]
        left = F.exists(F.zip_with(r["v"], last, lambda v, b: F.abs(v - b * step) > bound), lambda x: x)
        b = F.when((F.size(done) == 0) | left, F.transform(r["v"], fresh)).otherwise(last)
        return F.concat(done, F.array(F.struct(r["frame"].alias("frame"), b.alias("b"))))

    out = seq.select("entity", F.explode(F.aggregate("seq", start, fold)).alias("r"))
    return out.select("entity", "r.frame", *(F.col("r.b")[k].alias(f"bin_{c}") for k, c in enumerate(channels)))


def quantized(x: np.ndarray, step, integer: bool) -> np.ndarray:
    return np.floor((x + step // 2) / step) if integer else np.copysign(np.floor(np.abs(x / step) + 0.5), x)


def fold_tracks(v: np.ndarray, step, bound, integer: bool) -> np.ndarray:
    """(frames, entities, channels) to bins; NaN marks frames that a track doesn't have."""
    out = np.empty_like(v)
    out[0] = quantized(v[0], step, integer)
    for t in range(1, len(v)):
        left = (np.abs(v[t] - out[t - 1] * step) > bound).any(-1, keepdims=True)
        out[t] = np.where(left, quantized(v[t], step, integer), out[t - 1])
    return out


def hold_buckets(df: DataFrame, channels: list[str], step, bound, integer: bool, buckets: int | None = None) -> DataFrame:
    """The same by buckets of entities: a loop over frames, all entities of a bucket at once. Buckets grow in number with the shuffle partitions, unless they are given."""
    buckets = buckets or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bins = [f"bin_{c}" for c in channels]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entity", "frame"])
        codes, entities = pd.factorize(pdf["entity"])
        place = pdf.groupby("entity").cumcount().to_numpy()
        v = np.full((place.max() + 1, len(entities), len(channels)), np.nan)
        v[place, codes] = pdf[channels].to_numpy(float)
        b = fold_tracks(v, step, bound, integer)[place, codes]
        return pd.DataFrame({"entity": pdf["entity"], "frame": pdf["frame"]} | {n: b[:, k].astype("int64") for k, n in enumerate(bins)})

    rows = df.select(F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket"), "entity", "frame", *channels)
    return rows.groupBy("bucket").applyInPandas(run, f"entity bigint, frame bigint, {', '.join(b + ' bigint' for b in bins)}")
