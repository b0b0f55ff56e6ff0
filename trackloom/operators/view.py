"""Views of points: depth order, texels, culling, default camera, comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.ordering import ordinals
from trackloom.functions.scalar import axes, covariance, depth, texel_row, visible

BUCKETS = 65536


def depth_order(points: DataFrame, row, skip_invisible: bool = True) -> DataFrame:
    """(id, depth, bucket, place): front to back by 16-bit buckets, stable in file order. The range comes from visible points only; others are clamped."""
    d = points.select("id", depth(F.col("x"), F.col("y"), F.col("z"), row).alias("depth"), "alpha")
    seen = F.when(F.col("alpha") != 0, F.col("depth")) if skip_invisible else F.col("depth")
    span = d.agg(F.coalesce(F.min(seen), F.lit(0)).alias("near"), F.coalesce(F.max(seen), F.lit(1)).alias("far"))
    scaled = (F.col("depth") - F.col("near")) * ((BUCKETS - 1) / F.when(F.col("far") == F.col("near"), 1).otherwise(F.col("far") - F.col("near")))
    bucket = F.least(F.greatest(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)), F.lit(0)), F.lit(BUCKETS - 1)).cast("bigint")
    placed = d.join(F.broadcast(span)).select("id", "depth", bucket.alias("bucket"))  # span: one row
    return ordinals(placed, "bucket", "id", "place")


def same_view(a, b, frame_a: int, frame_b: int) -> bool:
    """Whether a new order can be skipped: the same frame, and view rows whose product is within 0.01 of 1."""
    return frame_a == frame_b and abs(float(np.dot(a, b)) - 1) < 0.01


def bucket_starts(order: DataFrame) -> DataFrame:
    """(bucket, n, start): counts and their exclusive sums, a row a used bucket."""
    n = order.groupBy("bucket").agg(F.count("*").alias("n"))
    return n.select("bucket", "n", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start"))


def sigma(points: DataFrame) -> DataFrame:
    """points with t0 .. t5: covariance terms from quaternions in 1/128 and log scales."""
    q = [F.col(f"q{k}") / 128.0 for k in range(4)]
    s = [F.exp(f"s{k}") for k in range(3)]
    return points.select("*", *(t.alias(f"t{k}") for k, t in enumerate(covariance(q, s))))


def texels(points: DataFrame) -> DataFrame:
    """(id, row, w4, w5, w6): the packed covariance words (four times the terms, two halves a word) and the texture row."""
    from trackloom.functions.arrow import pack_half

    s = sigma(points)
    pair = [(0, 1), (2, 3), (4, 5)]
    return s.select("id", texel_row(F.col("id")).cast("bigint").alias("row"), *(pack_half((F.col(f"t{a}") * 4).cast("float"), (F.col(f"t{b}") * 4).cast("float")).alias(f"w{4 + k}") for k, (a, b) in enumerate(pair)))


def health(points: DataFrame, terms: list[str], position: list[str]) -> DataFrame:
    """(max_sigma, bad_sigma, max_pos, bad_pos): finite extremes, and how many values are not finite."""
    def finite(c: Column) -> Column:
        return ~(F.isnan(c) | (F.abs(c) == float("inf")))

    def most(cols):
        return F.round(F.max(F.greatest(*(F.when(finite(F.col(c)), F.abs(F.col(c))) for c in cols))), 6)

    def bad(cols):
        return F.sum(sum((F.when(finite(F.col(c)), 0).otherwise(1) for c in cols[1:]), F.when(finite(F.col(cols[0])), 0).otherwise(1))).cast("bigint")

    return points.agg(most(terms).alias("max_sigma"), bad(terms).alias("bad_sigma"), most(position).alias("max_pos"), bad(position).alias("bad_pos"))


def look_at(position, target, up=(0.0, 1.0, 0.0)) -> np.ndarray:
    """A 4 x 4 world-to-camera matrix, column vectors."""
    p, t = np.asarray(position, float), np.asarray(target, float)
    f = (t - p) / np.linalg.norm(t - p)
    r = np.cross(np.asarray(up, float), f)
    r /= np.linalg.norm(r)
    out = np.eye(4)
    out[:3, :3] = np.stack([r, np.cross(f, r), f])
    out[:3, 3] = -out[:3, :3] @ p
    return out


def projection(fx: float, fy: float, width: float, height: float, near: float = 0.2, far: float = 200.0) -> np.ndarray:
    out = np.zeros((4, 4))
    out[0, 0], out[1, 1] = 2 * fx / width, -2 * fy / height
    out[2, 2], out[2, 3], out[3, 2] = far / (far - near), -far * near / (far - near), 1.0
    return out


def rotate(m: np.ndarray, angle: float, axis) -> np.ndarray:
    """m followed by a turn about an axis (Rodrigues)."""
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    turn = np.eye(4)
    turn[:3, :3] += np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
    return m @ turn


def translate(m: np.ndarray, by) -> np.ndarray:
    move = np.eye(4)
    move[:3, 3] = by
    return m @ move


def invert(m: np.ndarray) -> np.ndarray | None:
    return np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else None


def multiply_row(m: np.ndarray, k: int, cols: list[Column]) -> Column:
    return float(m[k, 0]) * cols[0] + float(m[k, 1]) * cols[1] + float(m[k, 2]) * cols[2] + float(m[k, 3])


def project(points: DataFrame, view: np.ndarray, proj: np.ndarray, focal=(1000.0, 1000.0)) -> DataFrame:
    """points (with t0 .. t5) with clip coordinates, whether they are drawn, and the two screen axes of their ellipses."""
    p = [F.col(c) for c in "xyz"]
    cam = points.select("*", *(multiply_row(view, k, p).alias(f"cam{k}") for k in range(3)))
    c = [F.col(f"cam{k}") for k in range(3)]
    clip = cam.select("*", *(multiply_row(proj, k, c).alias(f"clip{k}") for k in range(4)))
    # rows of J * W, where J is the perspective's derivative at the point and W the view's rotation
    j = [[focal[0] / c[2], F.lit(0.0), -focal[0] * c[0] / (c[2] * c[2])], [F.lit(0.0), -focal[1] / c[2], focal[1] * c[1] / (c[2] * c[2])]]
    rows = [[sum((j[r][k] * float(view[k, n]) for k in range(1, 3)), j[r][0] * float(view[0, n])) for n in range(3)] for r in range(2)]
    clip = clip.select("*", *(rows[r][n].alias(f"g{r}{n}") for r in range(2) for n in range(3)))  # columns, so that what follows stays small
    g = [[F.col(f"g{r}{n}") for n in range(3)] for r in range(2)]
    sym = [["t0", "t1", "t2"], ["t1", "t3", "t4"], ["t2", "t4", "t5"]]

    half = [[sum((g[r][m] * F.col(sym[m][n]) for m in (1, 2)), g[r][0] * F.col(sym[0][n])).alias(f"h{r}{n}") for n in range(3)] for r in range(2)]
    clip = clip.select("*", *half[0], *half[1])

    def form(a, b):
        return sum((F.col(f"h{a}{n}") * g[b][n] for n in (1, 2)), F.col(f"h{a}0") * g[b][0])

    out = clip.select("*", form(0, 0).alias("c00"), form(0, 1).alias("c01"), form(1, 1).alias("c11"))
    low, major, minor = axes(F.col("c00"), F.col("c01"), F.col("c11"))
    drawn = visible(*(F.col(f"clip{k}") for k in range(4))) & (low >= 0)
    return out.select("*", drawn.alias("drawn"), major.alias("major"), minor.alias("minor"))


def split_screen(points: DataFrame, divider: float, side: int) -> DataFrame:
    """Points on one side of a vertical divider in normalised device coordinates."""
    return points.where((F.col("clip0") / F.col("clip3") - divider) * side >= 0)


def default_camera(box: DataFrame) -> DataFrame:
    """(px, py, pz, tx, ty, tz) from a bounding box (min_x .. max_z): the origin, if the box holds it, else the middle."""
    inside = (F.col("min_x") < 0) & (F.col("max_x") > 0) & (F.col("min_z") < 0) & (F.col("max_z") > 0)

    def mid(c):
        return (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2

    t = box.select(F.when(inside, 0.0).otherwise(mid("x")).alias("tx"), F.when(inside, -0.9).otherwise(mid("y")).alias("ty"), F.when(inside, 0.3).otherwise(mid("z")).alias("tz"))
    return t.select(F.round("tx", 6).alias("px"), F.round(F.col("ty") - 0.3, 6).alias("py"), F.round(F.col("tz") - 2.9, 6).alias("pz"), *(F.round(c, 6).alias(c) for c in ("tx", "ty", "tz")))


def pixel_diff(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """(pixels, mean_diff, max_diff, over16): of two images by position."""
    both = a.join(b.select(*keys, *(F.col(c).alias(f"_{c}") for c in channels)), keys)
    d = both.select(F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in channels)).alias("d"))
    return d.agg(F.count("*").alias("pixels"), F.round(F.avg("d"), 6).alias("mean_diff"), F.max("d").cast("bigint").alias("max_diff"), F.round(F.avg((F.col("d") > 16).cast("int")) * 100, 6).alias("over16"))
