"""Track views over ordinary tables, and what is done to a signal before it is coded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, frame, v): the values of each user's events in time order."""
    e = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("entity"), frame.cast("bigint").alias("frame"), F.col("value").alias("v"))


LI_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")


def li_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, frame, c0, c1, c2): three integer channels of each part's lines in time order."""
    li = table(spark, sf_dir, "lineitem")
    frame = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*LI_ORDER)) - 1
    return li.select(
        F.col("l_partkey").alias("entity"), frame.cast("bigint").alias("frame"), F.col("l_quantity").cast("bigint").alias("c0"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("c1"), F.round(F.col("l_tax") * 100).cast("bigint").alias("c2"),
    )


def emb_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(splat_id, label, x, y, z, q0 .. q3, s0 .. s2): points with a quaternion in 1/128 and log scales, from embeddings."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    at = [F.col("embedding")[k].cast("double") for k in range(10)]
    norm = F.sqrt(sum((at[k] * at[k] for k in range(4, 7)), at[3] * at[3]))
    q = [F.least(F.greatest(F.round(at[3 + k] / norm * 128), F.lit(-128.0)), F.lit(127.0)).cast("bigint").alias(f"q{k}") for k in range(4)]
    return e.select(F.col("vec_id").alias("splat_id"), F.col("label").cast("bigint").alias("label"), *(at[k].alias(c) for k, c in enumerate("xyz")), *q, *(at[7 + k].alias(f"s{k}") for k in range(3)))


def flip(q: np.ndarray) -> np.ndarray:
    """The other sign of a quaternion in -128 .. 127; 128 doesn't fit and becomes 127."""
    return np.minimum(-q, 127)


def canonical_signs(q: np.ndarray) -> np.ndarray:
    """(frames, ..., 4): each frame is flipped where its dot product with the frame before, as already flipped, is negative."""
    out = q.copy()
    for t in range(1, len(q)):
        turn = (out[t].astype(np.int64) * out[t - 1]).sum(-1) < 0
        out[t] = np.where(turn[..., None], flip(out[t]), out[t])
    return out


def canonicalize(df: DataFrame, entity: str, frame: str, q: tuple[str, str, str, str] = ("q0", "q1", "q2", "q3")) -> DataFrame:
    """Quaternion tracks with continuous signs: (entity, frame, q0 .. q3). A true fold over an entity's frames."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        pdf[list(q)] = canonical_signs(pdf[list(q)].to_numpy(np.int64))
        return pdf

    rows = df.select(F.col(entity).cast("bigint").alias("entity"), F.col(frame).cast("bigint").alias("frame"), *(F.col(c).cast("bigint").alias(c) for c in q))
    return rows.groupBy("entity").applyInPandas(fold, rows.schema)


def canonicalize_sql(df: DataFrame, entity: str, frame: str, q: tuple[str, ...] = ("q0", "q1", "q2", "q3")) -> DataFrame:
    """The same as built-in expressions: an aggregate over an entity's sorted array of frames."""
    row = F.struct(F.col(frame).cast("bigint").alias("frame"), F.array(*(F.col(c).cast("bigint") for c in q)).alias("q"))
    seq = df.groupBy(F.col(entity).cast("bigint").alias("entity")).agg(F.array_sort(F.collect_list(row)).alias("seq"))
    start = F.array().cast("array<struct<frame:bigint,q:array<bigint>>>")

    def step(done, r):
        last = F.element_at(done, -1)["q"]
        dot = F.aggregate(F.zip_with(last, r["q"], lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        flipped = F.transform(r["q"], lambda x: F.least(-x, F.lit(127).cast("bigint")))
        turned = F.when((F.size(done) > 0) & (dot < 0), flipped).otherwise(r["q"])
        return F.concat(done, F.array(F.struct(r["frame"].alias("frame"), turned.alias("q"))))

    out = seq.select("entity", F.explode(F.aggregate("seq", start, step)).alias("r"))
    return out.select("entity", "r.frame", *(F.col("r.q")[k].alias(c) for k, c in enumerate(q)))


def median5(v: str, entity: str = "entity", frame: str = "frame") -> Column:
    """The median of five frames around each; beyond the ends the end frame is repeated."""
    w = Window.partitionBy(entity).orderBy(frame)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    around = [F.coalesce(F.lag(v, k).over(w), first) for k in (2, 1)] + [F.col(v)] + [F.coalesce(F.lead(v, k).over(w), last) for k in (1, 2)]
    return F.array_sort(F.array(*around))[2]


def denoise(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.select("*", *(median5(c).alias(f"{c}_ref") for c in channels))


def denoise_stats(df: DataFrame, channels: list[str]) -> DataFrame:
    """(mean_dev, p99_dev): mean absolute change, and the least level that 99 % of the changes don't exceed, from the exact histogram."""
    d = denoise(df, channels).select(F.explode(F.array(*(F.abs(F.col(c) - F.col(f"{c}_ref")) for c in channels))).alias("d"))
    h = d.groupBy("d").agg(F.count("*").alias("n"))
    w = Window.orderBy("d")  # a row a level
    total = Window.partitionBy()
    levels = h.select("d", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(total).alias("all"))
    return levels.agg(F.round(F.sum(F.col("d") * F.col("n")) / F.max("all"), 6).alias("mean_dev"), F.min(F.when(F.col("upto") >= 0.99 * F.col("all"), F.col("d"))).alias("p99_dev"))
