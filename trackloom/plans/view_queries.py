"""Views of points from embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import arrow, scalar
from trackloom.operators import view
from trackloom.operators.tracks import emb_splat, li_track
from trackloom.plans.registry import EMB, LI, query

_NAMES = "xyz"


def _cov_sql():
    q = [f"(q{k} / 128.0)" for k in range(4)]
    w, x, y, z = q
    r = [[f"(1 - 2 * ({y}*{y} + {z}*{z}))", f"(2 * ({x}*{y} - {w}*{z}))", f"(2 * ({x}*{z} + {w}*{y}))"], [f"(2 * ({x}*{y} + {w}*{z}))", f"(1 - 2 * ({x}*{x} + {z}*{z}))", f"(2 * ({y}*{z} - {w}*{x}))"], [f"(2 * ({x}*{z} - {w}*{y}))", f"(2 * ({y}*{z} + {w}*{x}))", f"(1 - 2 * ({x}*{x} + {y}*{y}))"]]
    m = ", ".join(f"{r[i][k]} * exp(s{k}) AS m{i}{k}" for i in range(3) for k in range(3))
    t = [f"m{i}0 * m{j}0 + m{i}1 * m{j}1 + m{i}2 * m{j}2" for i in range(3) for j in range(i, 3)]
    return f"{EMB}, mm AS (SELECT *, {m} FROM emb), sg AS (SELECT *, {', '.join(f'{e} AS t{k}' for k, e in enumerate(t))} FROM mm)"


SIGMA = _cov_sql()
TERMS = [f"t{k}" for k in range(6)]


@query(f"WITH {SIGMA} SELECT splat_id, {', '.join(f'round({t}, 6) AS {t}' for t in TERMS)} FROM sg")
def covariance(spark, sf_dir):
    return view.sigma(emb_splat(spark, sf_dir)).select("splat_id", *(F.round(t, 6).alias(t) for t in TERMS))


@query()
def half_pack(spark, sf_dir):
    """Covariance words in truncated halves, with the texture row of each point."""
    return view.texels(emb_splat(spark, sf_dir).withColumnRenamed("splat_id", "id"))


@query(f"WITH {SIGMA} SELECT splat_id, true AS near FROM sg")
def half_unpack(spark, sf_dir):
    """Packed halves read back lie within the truncation of 10 bits."""
    s = view.sigma(emb_splat(spark, sf_dir)).select("splat_id", F.col("t0").cast("float").alias("a"), F.col("t1").cast("float").alias("b"))
    w = s.withColumn("w", arrow.pack_half("a", "b")).select("*", arrow.unpack_low("w").alias("ua"), arrow.unpack_high("w").alias("ub"))
    return w.select("splat_id", ((F.abs(F.col("a") - F.col("ua")) <= F.abs("a") / 1024 + 1e-6) & (F.abs(F.col("b") - F.col("ub")) <= F.abs("b") / 1024 + 1e-6)).alias("near"))


@query(f"WITH {SIGMA} SELECT round(max(greatest({', '.join(f'abs({t})' for t in TERMS)})), 6) AS max_sigma, 0::BIGINT AS bad_sigma, round(max(greatest(abs(x), abs(y), abs(z))), 6) AS max_pos, 0::BIGINT AS bad_pos FROM sg")
def view_health(spark, sf_dir):
    return view.health(view.sigma(emb_splat(spark, sf_dir)), TERMS, list(_NAMES))


@query(f"WITH {EMB} SELECT splat_id, ((2 * splat_id) >> 11)::BIGINT AS row FROM emb")
def texel_rows(spark, sf_dir):
    return emb_splat(spark, sf_dir).select("splat_id", scalar.texel_row(F.col("splat_id")).cast("bigint").alias("row"))


ROW = (0.25, -0.5, 0.75)
_DEPTH = f"{EMB}, dp AS (SELECT splat_id AS id, trunc((0.25 * x + -0.5 * y + 0.75 * z) * 4096)::BIGINT AS depth, splat_id % 7 AS alpha FROM emb), sp AS (SELECT min(depth) FILTER (alpha <> 0) AS near, max(depth) FILTER (alpha <> 0) AS far FROM dp), bk AS (SELECT id, depth, least(greatest(trunc((depth - near) * (65535 / CASE WHEN far = near THEN 1 ELSE far - near END)), 0), 65535)::BIGINT AS bucket FROM dp, sp)"


def _points(spark, sf_dir):
    return emb_splat(spark, sf_dir).select(F.col("splat_id").alias("id"), "x", "y", "z", (F.col("splat_id") % 7).alias("alpha"))


@query(f"WITH {_DEPTH} SELECT id, depth, bucket, row_number() OVER (ORDER BY bucket, id) - 1 AS place FROM bk")
def depth_sort(spark, sf_dir):
    return view.depth_order(_points(spark, sf_dir), ROW)


@query(f"WITH {_DEPTH}, n AS (SELECT bucket, count(*) AS n FROM bk GROUP BY bucket) SELECT bucket, n, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n")
def depth_starts(spark, sf_dir):
    return view.bucket_starts(view.depth_order(_points(spark, sf_dir), ROW))


VIEW, PROJ = view.look_at((0.1, -0.2, -0.6), (0.0, 0.0, 0.2)), view.projection(1000, 1000, 1280, 720)


def _row(m, k, cols):
    return " + ".join(f"{float(m[k, n])!r} * {c}" for n, c in enumerate(cols)) + f" + {float(m[k, 3])!r}"


_CLIP = f"{EMB}, cm AS (SELECT *, {', '.join(f'{_row(VIEW, k, _NAMES)} AS cam{k}' for k in range(3))} FROM emb), cl AS (SELECT *, {', '.join(f'{_row(PROJ, k, ['cam0', 'cam1', 'cam2'])} AS clip{k}' for k in range(4))} FROM cm)"
_IN = "(clip2 >= -1.2 * clip3 AND clip0 >= -1.2 * clip3 AND clip0 <= 1.2 * clip3 AND clip1 >= -1.2 * clip3 AND clip1 <= 1.2 * clip3)"


def _projected(spark, sf_dir):
    return view.project(view.sigma(emb_splat(spark, sf_dir)), np.asarray(VIEW), np.asarray(PROJ))


@query(f"WITH {_CLIP} SELECT splat_id, {_IN} AS inside, {', '.join(f'round(clip{k}, 6) AS clip{k}' for k in range(4))} FROM cl")
def frustum_cull(spark, sf_dir):
    p = _projected(spark, sf_dir)
    inside = scalar.visible(*(F.col(f"clip{k}") for k in range(4)))
    return p.select("splat_id", inside.alias("inside"), *(F.round(f"clip{k}", 6).alias(f"clip{k}") for k in range(4)))


@query()
def screen_ellipses(spark, sf_dir):
    """Which points are drawn, and their axes on the screen. (A filter on `drawn` would be pushed below the projections and repeat them.)"""
    return _projected(spark, sf_dir).select("splat_id", "drawn", F.round("major", 3).alias("major"), F.round("minor", 3).alias("minor"))


@query(f"WITH {_CLIP} SELECT splat_id FROM cl WHERE {_IN} AND clip0 / clip3 - 0.1 >= 0")
def split_screen(spark, sf_dir):
    p = _projected(spark, sf_dir).where(scalar.visible(*(F.col(f"clip{k}") for k in range(4))))
    return view.split_screen(p, 0.1, 1).select("splat_id")


@query(f"WITH {EMB}, b AS (SELECT {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in _NAMES)} FROM emb), t AS (SELECT *, min_x < 0 AND max_x > 0 AND min_z < 0 AND max_z > 0 AS i FROM b), c AS (SELECT CASE WHEN i THEN 0.0::DOUBLE ELSE (min_x + max_x) / 2 END AS tx, CASE WHEN i THEN -0.9::DOUBLE ELSE (min_y + max_y) / 2 END AS ty, CASE WHEN i THEN 0.3::DOUBLE ELSE (min_z + max_z) / 2 END AS tz FROM t) SELECT round(tx, 6) AS px, round(ty - 0.3, 6) AS py, round(tz - 2.9, 6) AS pz, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz FROM c")
def default_camera(spark, sf_dir):
    e = emb_splat(spark, sf_dir)
    return view.default_camera(e.agg(*(f for c in _NAMES for f in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")))))


@query(f"WITH {LI}, d AS (SELECT greatest(abs(c0 * 5 - floor((c0 * 5 + 20) / 41.0)::BIGINT * 41), abs(c1 - floor((c1 + 4) / 9.0)::BIGINT * 9)) AS d FROM li) SELECT count(*) AS pixels, round(avg(d), 6) AS mean_diff, max(d)::BIGINT AS max_diff, round(avg((d > 16)::INT) * 100, 6) AS over16 FROM d")
def pixel_diff(spark, sf_dir):
    """Two images by position: a signal and its quantized copy."""
    a = li_track(spark, sf_dir).select("entity", "frame", (F.col("c0") * 5).alias("c0"), "c1")
    b = a.select("entity", "frame", (scalar.quantize_int(F.col("c0"), 41) * 41).alias("c0"), (scalar.quantize_int(F.col("c1"), 9) * 9).alias("c1"))
    return view.pixel_diff(a, b, ["entity", "frame"], ["c0", "c1"])
