"""Other sources of points: tracked arrays (NPZ), motion models, PLY files; all give rows of the `splat` schema."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.scalar import motion, opacity_over_time, sh_level, sigmoid
from trackloom.sources.splat import COLUMNS, SCHEMA

NPZ_FPS = 20.0
#: Fixed values of the motion-model file: magic number, words of a record.
MOTION_MAGIC, MOTION_WORDS = 0x674B, 16


def from_npz(spark: SparkSession, path: str, max_frames: int | None = None) -> DataFrame:
    """Means and colours by frame, scales and opacities as logs and logits once; a task makes one frame."""
    with np.load(path) as z:
        n = len(z["means3D"])
    frames = spark.range(min(n, max_frames or n), numPartitions=max(1, min(n, 64)))

    def run(batches):
        with np.load(path) as z:
            means, colours, turns, scales, logits = (z[k] for k in ("means3D", "rgb_colors", "unnorm_rotations", "log_scales", "logit_opacities"))
            for pdf in batches:
                for t in pdf["id"]:
                    q = turns[t] / np.maximum(np.linalg.norm(turns[t], axis=1, keepdims=True), 1e-12)
                    level = lambda v: np.clip(np.rint(v), 0, 255)
                    s, a = np.exp(scales), level(255 / (1 + np.exp(-logits)))
                    m = len(means[t])
                    cols = [np.full(m, t), np.arange(m), *means[t].T, *s.T, *level(colours[t] * 255).T, a.reshape(m), *level(q * 128 + 128).T]
                    yield pd.DataFrame(dict(zip(COLUMNS, cols))).astype({c: "int16" for c in COLUMNS[8:]} | {c: "float32" for c in COLUMNS[2:8]} | {"frame": "int32", "splat_id": "int32"})

    return frames.mapInPandas(run, SCHEMA)


def motion_records(path: str) -> pd.DataFrame:
    """The model's points: position, quaternion, scales, colour, cubic motion, angular velocity, time centre and width."""
    with open(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MOTION_MAGIC:
            raise ValueError("not a motion model")
        json.loads(f.read(size))
        raw = f.read()
    w = np.frombuffer(raw[: len(raw) // (4 * MOTION_WORDS) * 4 * MOTION_WORDS], "<u4").reshape(-1, MOTION_WORDS)
    pos, h, c = w[:, :3].copy().view("<f4"), w.copy().view("<f2").astype(float), w[:, 7:8].copy().view("u1")
    out = {k: pos[:, i].astype(float) for i, k in enumerate("xyz")}
    out |= {f"q{i}": h[:, 6 + i] for i in range(4)} | {f"s{k}": h[:, 10 + i] for i, k in enumerate("xyz")} | {k: c[:, i].astype(int) for i, k in enumerate("rgba")}
    out |= {f"m{i}": h[:, 16 + i] for i in range(9)} | {f"w{i}": h[:, 26 + i] for i in range(4)} | {"centre": h[:, 30], "width": np.exp(h[:, 31])}
    return pd.DataFrame(out)


def from_motion(spark: SparkSession, path: str, frames: int, rate: float = 20.0) -> DataFrame:
    """The model evaluated at evenly spaced times; times are broadcast to the points."""
    points = spark.createDataFrame(motion_records(path).rename_axis("splat_id").reset_index())
    times = spark.range(frames).select(F.col("id").cast("int").alias("frame"), (F.col("id") / float(max(frames - 1, 1))).alias("t"))
    p = points.join(F.broadcast(times)).withColumn("dt", F.col("t") - F.col("centre"))
    moved = [motion(F.col(c), [F.col(f"m{k}"), F.col(f"m{k + 3}"), F.col(f"m{k + 6}")], F.col("dt")) for k, c in enumerate("xyz")]
    turned = [F.col(f"q{k}") + F.col(f"w{k}") * F.col("dt") for k in range(4)]
    norm = F.greatest(F.sqrt(sum((t * t for t in turned[1:]), turned[0] * turned[0])), F.lit(1e-12))
    byte = lambda v: F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("smallint")
    alpha = byte(opacity_over_time(F.col("a").cast("double"), F.col("dt"), F.col("width")))
    return p.select("frame", F.col("splat_id").cast("int").alias("splat_id"), *(m.cast("float").alias(c) for m, c in zip(moved, "xyz")), *(F.col(f"s{c}").cast("float").alias(f"s{c}") for c in "xyz"), *(F.col(c).cast("smallint").alias(c) for c in "rgb"), alpha.alias("a"), *(byte(t / norm * 128 + 128).alias(f"q{k}") for k, t in enumerate(turned)))


#: Types of a PLY header.
PLY_TYPES = {"double": "<f8", "int": "<i4", "uint": "<u4", "float": "<f4", "short": "<i2", "ushort": "<u2", "uchar": "u1"}


def is_ply(data: bytes) -> bool:
    return data[:4] == b"ply\n"


def ply_table(data: bytes) -> pd.DataFrame:
    """The vertices; the schema is what the header declares, unknown types are signed bytes."""
    if not is_ply(data):
        raise ValueError("not a PLY file")
    head, _, body = data.partition(b"end_header\n")
    lines = [x.split() for x in head.decode().splitlines()]
    n = next(int(x[2]) for x in lines if x[:2] == ["element", "vertex"])
    kind = np.dtype([(x[2], PLY_TYPES.get(x[1], "i1")) for x in lines if x and x[0] == "property"])
    return pd.DataFrame(np.frombuffer(body, kind, n))


def from_ply(spark: SparkSession, path: str) -> DataFrame:
    """One frame, the most important points first (volume times opacity)."""
    with open(path, "rb") as f:
        t = ply_table(f.read())
    df = spark.createDataFrame(t.rename_axis("i").reset_index())
    has = set(t.columns)
    scale = [F.exp(f"scale_{k}") if f"scale_{k}" in has else F.lit(0.01) for k in range(3)]
    opacity = sigmoid(F.col("opacity")) if "opacity" in has else F.lit(1.0)
    turn = [F.col(f"rot_{k}") if f"rot_{k}" in has else F.lit(1.0 if k == 0 else 0.0) for k in range(4)]
    norm = F.greatest(F.sqrt(sum((q * q for q in turn[1:]), turn[0] * turn[0])), F.lit(1e-12))
    colour = [sh_level(F.col(f"f_dc_{k}")) if f"f_dc_{k}" in has else F.col(c) if c in has else F.lit(255) for k, c in enumerate(("red", "green", "blue"))]
    byte = lambda v: F.least(F.greatest(F.rint(v.cast("double")), F.lit(0.0)), F.lit(255.0)).cast("smallint")
    rows = df.select("i", (scale[0] * scale[1] * scale[2] * opacity).alias("weight"), *(F.col(c).cast("float").alias(c) for c in "xyz"), *(s.cast("float").alias(f"s{c}") for s, c in zip(scale, "xyz")), *(byte(v).alias(c) for v, c in zip(colour, "rgb")), byte(opacity * 255).alias("a"), *(byte(q / norm * 128 + 128).alias(f"q{k}") for k, q in enumerate(turn)))
    from trackloom.functions.ordering import ordinals

    placed = ordinals(rows.withColumn("less", -F.col("weight")), "less", "i", "splat_id")
    return placed.select(F.lit(0).alias("frame"), F.col("splat_id").cast("int").alias("splat_id"), *COLUMNS[2:])
