"""Measurements over track views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar
from trackloom.operators import analysis, hold
from trackloom.operators.tracks import emb_splat, ev_track, li_track
from trackloom.plans.registry import EMB, EV, LI, query

CH = ["c0", "c1", "c2"]
_FIRST = "fs AS (SELECT entity, arg_min(c0, frame) AS f0, arg_min(c1, frame) AS f1, arg_min(c2, frame) AS f2 FROM li GROUP BY entity)"
_FAR = f"{LI}, {_FIRST}, far AS (SELECT entity, entity % 2 AS fg, max(sqrt((c0 - f0) ** 2 + (c1 - f1) ** 2 + (c2 - f2) ** 2)) AS far FROM li JOIN fs USING (entity) GROUP BY ALL)"


@query(f"WITH {_FAR} SELECT l AS \"limit\", fg, count(*) AS n, round(avg((far <= l)::INT), 6) AS frac FROM far, (SELECT unnest([10.0, 30.0, 40.0, 45.0, 48.0, 60.0])::DOUBLE AS l) GROUP BY ALL")
def displacement_static(spark, sf_dir):
    li = li_track(spark, sf_dir).withColumn("fg", F.col("entity") % 2)
    return analysis.displacement_static(li, CH, [10, 30, 40, 45, 48, 60], "fg")


@query(f"WITH {LI}, w AS (SELECT *, unnest([2, 5, 10])::BIGINT AS width FROM li), g AS (SELECT width, entity, frame // width AS k, greatest(max(c1) - min(c1), max(c2) - min(c2)) AS span FROM w GROUP BY ALL) SELECT width, bound, count(*) AS n, round(avg((span <= 2 * bound)::INT), 6) AS frac FROM (SELECT *, unnest([1, 2, 4])::BIGINT AS bound FROM g) GROUP BY ALL")
def windowed_static(spark, sf_dir):
    return analysis.windowed_static(li_track(spark, sf_dir), ["c1", "c2"], [2, 5, 10], [1, 2, 4])


@query(f"WITH {EV}, s AS (SELECT stddev_pop(v) AS s FROM ev GROUP BY entity) SELECT " + ", ".join(f"round(quantile_cont(s, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 95)) + " FROM s")
def temporal_std_pct(spark, sf_dir):
    return analysis.temporal_std(ev_track(spark, sf_dir), "v")


@query(f"WITH {EV}, d AS (SELECT entity, frame, v - lag(v) OVER (PARTITION BY entity ORDER BY frame) AS d FROM ev), p AS (SELECT d, lag(d) OVER (PARTITION BY entity ORDER BY frame) AS p FROM d WHERE d IS NOT NULL) SELECT count(p) AS pairs, round(sum(d * p) / sum(CASE WHEN p IS NOT NULL THEN d * d END), 6) AS autocorr FROM p")
def autocorr(spark, sf_dir):
    return analysis.lag1(ev_track(spark, sf_dir), "v")


@query(f"WITH {EV}, m AS (SELECT frame, avg(v) AS m FROM ev GROUP BY frame) SELECT count(*) AS frames, round(max(m) - min(m), 6) AS mean_range FROM m")
def frame_mean_range(spark, sf_dir):
    return analysis.frame_mean_range(ev_track(spark, sf_dir), "v")


_OFF = ", ".join(f"round(quantile_cont((c{k} - f{k})::DOUBLE, 0.5), 6) AS off_c{k}" for k in range(3))


@query(f"WITH {LI}, {_FIRST} SELECT frame, {_OFF} FROM li JOIN fs USING (entity) GROUP BY frame")
def frame_median_offset(spark, sf_dir):
    return analysis.frame_median_offset(li_track(spark, sf_dir), CH)


@query(f"WITH RECURSIVE {LI}, {_FIRST}, o AS (SELECT frame, round(quantile_cont((c0 - f0)::DOUBLE, 0.5), 6) AS off FROM li JOIN fs USING (entity) GROUP BY frame), a AS MATERIALIZED (SELECT entity, frame, c0 - round(off)::BIGINT AS c FROM li JOIN o USING (frame)), h AS (SELECT entity, frame, floor((c + 4) / 9.0)::BIGINT AS bin_c0 FROM a WHERE frame = 0 UNION ALL SELECT a.entity, a.frame, CASE WHEN abs(a.c - h.bin_c0 * 9) > 12 THEN floor((a.c + 4) / 9.0)::BIGINT ELSE h.bin_c0 END FROM h JOIN a ON a.entity = h.entity AND a.frame = h.frame + 1) SELECT * FROM h")
def hold_without_offset(spark, sf_dir):
    return hold.hold(analysis.remove_offset(li_track(spark, sf_dir).select("entity", "frame", "c0"), "c0"), ["c0"], 9, 12, True)


@query(f"""WITH {EV}, e AS (SELECT *, unnest([2.0, 10.0, 50.0])::DOUBLE AS bound FROM ev), m AS (SELECT *, max(v) OVER w - min(v) OVER w AS span FROM e WINDOW w AS (PARTITION BY bound, entity)),
q AS (SELECT bound, entity, frame, round(v / (2 * bound))::BIGINT AS q FROM m WHERE span > 2 * bound), d AS (SELECT bound, entity, q - lag(q) OVER (PARTITION BY bound, entity ORDER BY frame) AS d FROM q),
y AS (SELECT bound, count(DISTINCT entity) AS dyn FROM d GROUP BY bound), h AS (SELECT bound, d, count(*) AS c FROM d WHERE d IS NOT NULL GROUP BY ALL),
t AS (SELECT bound, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (d = 0), 0)::BIGINT AS zero, coalesce(sum(c) FILTER (abs(d) > 15), 0)::BIGINT AS far, sum(c * log2(c)) AS clog FROM h GROUP BY bound)
SELECT bound, dyn, n, zero, far, round(log2(n) - clog / n, 6) AS entropy FROM t JOIN y USING (bound)""")
def delta_entropy_by_bound(spark, sf_dir):
    return analysis.delta_report(ev_track(spark, sf_dir), "v", [2, 10, 50])


@query(f"""WITH {LI}, v AS (SELECT entity, frame, unnest(['c0', 'c1', 'c2']) AS attr, unnest([c0, c1, c2]) AS v FROM li), g AS (SELECT b::BIGINT AS bound, g::BIGINT AS gop FROM (SELECT unnest([1, 4]) AS b), (SELECT unnest([5, 15, 60]) AS g)),
q AS (SELECT *, floor((v + bound) / (2.0 * bound + 1))::BIGINT AS q FROM v, g), s AS (SELECT bound, gop, attr, (frame % gop <> 0)::INT AS kind, q - CASE WHEN frame % gop = 0 THEN 0 ELSE lag(q) OVER (PARTITION BY bound, gop, attr, entity ORDER BY frame) END AS d FROM q),
h AS (SELECT bound, gop, attr, kind, d, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT bound, gop, attr, kind, sum(n) AS n, sum(n * log2(n)) AS nlog FROM h GROUP BY ALL)
SELECT bound, gop, sum(n)::BIGINT AS symbols, round(sum((n * log2(n) - nlog) / 8), 6) AS entropy_bytes FROM t GROUP BY ALL""")
def parameter_sweep(spark, sf_dir):
    return analysis.sweep(li_track(spark, sf_dir), CH, [1, 4], [5, 15, 60])


@query(f"""WITH {LI}, e AS (SELECT entity, frame, c0, unnest([2.0, 4.0])::DOUBLE AS beta, c2 FROM li), b AS (SELECT *, least(greatest(2, floor(beta / greatest(c2 / 8.0, 1e-6))::BIGINT), 64) AS bound FROM e), q AS (SELECT beta, entity, frame, floor((c0 + bound) / (2.0 * bound + 1))::BIGINT AS q FROM b),
h AS (SELECT beta, q, count(*) AS n FROM q GROUP BY ALL) SELECT beta, sum(n)::BIGINT AS n, round((sum(n) * log2(sum(n)) - sum(n * log2(n))) / 8, 6) AS entropy_bytes FROM h GROUP BY beta""")
def weighted_sweep(spark, sf_dir):
    from trackloom.operators.symbols import entropy_bytes

    e = li_track(spark, sf_dir).select("c0", "c2", F.explode(F.array(F.lit(2.0), F.lit(4.0))).alias("beta"))
    b = e.withColumn("bound", F.least(F.greatest(F.lit(2), F.floor(F.col("beta") / F.greatest(F.col("c2") / 8.0, F.lit(1e-6)))), F.lit(64)))
    q = b.select("beta", F.floor((F.col("c0") + F.col("bound")) / (2.0 * F.col("bound") + 1)).alias("q"))
    return entropy_bytes(q.groupBy("beta", "q").agg(F.count("*").alias("n")), ["beta"])


@query(f"WITH {LI}, a AS (SELECT c2 / 8.0 AS a FROM li) SELECT count(a) AS n, round(avg((a < 0.1)::INT), 6) AS b0, round(avg((a >= 0.1 AND a < 0.35)::INT), 6) AS b1, round(avg((a >= 0.35 AND a < 0.7)::INT), 6) AS b2, round(avg((a >= 0.7)::INT), 6) AS b3 FROM a")
def alpha_buckets(spark, sf_dir):
    return analysis.buckets(li_track(spark, sf_dir).select((F.col("c2") / 8.0).alias("a")), "a", [0.1, 0.35, 0.7])


@query(f"WITH {EMB} SELECT splat_id, round(0.5 * 255 + 0.28209479 * x * 255, 6) AS red, round(1 / (1 + exp(-y)), 6) AS opacity, round(exp(s0 + s1 + s2) / (1 + exp(-y)), 6) AS importance FROM emb")
def point_import(spark, sf_dir):
    """The conversions of a point import: harmonics to levels, opacity out of its logit, importance."""
    e = emb_splat(spark, sf_dir)
    return e.select("splat_id", F.round(scalar.sh_level(F.col("x")), 6).alias("red"), F.round(scalar.sigmoid(F.col("y")), 6).alias("opacity"), F.round(F.exp(F.col("s0") + F.col("s1") + F.col("s2")) * scalar.sigmoid(F.col("y")), 6).alias("importance"))


@query(f"WITH {EMB} SELECT splat_id, round(exp(s0 + s1 + s2) / (1 + exp(-y)), 6) AS importance FROM emb ORDER BY 2 DESC, 1 LIMIT 20")
def importance_topk(spark, sf_dir):
    return point_import(spark, sf_dir).select("splat_id", "importance").orderBy(F.desc("importance"), "splat_id").limit(20)


_FR = "f AS (SELECT t / 10.0 AS t FROM (SELECT unnest(range(0, 10)) AS t))"


@query(f"""WITH {_FR}, p AS (SELECT p_partkey AS id, p_size / 50.0 AS c, p_retailprice AS x, p_size * 1.0 AS v FROM part), m AS (SELECT *, t - c AS dt FROM p, f)
SELECT id, round(t, 6) AS t, round(x + dt * (v + dt * (v / 2 + dt * (v / 4))), 6) AS pos, round(CASE WHEN exp(-((dt / greatest(0.3, 1e-6)) ** 2)) < 0.02 THEN 0.0 ELSE 255 * exp(-((dt / greatest(0.3, 1e-6)) ** 2)) END, 6) AS alpha FROM m""")
def motion_model(spark, sf_dir):
    """Points with a cubic path and a fading opacity, at ten times; the times are broadcast."""
    from trackloom.operators.tracks import table

    times = spark.range(10).select((F.col("id") / 10.0).alias("t"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("c"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 1.0).alias("v"))
    m = p.join(F.broadcast(times)).withColumn("dt", F.col("t") - F.col("c"))
    pos = scalar.motion(F.col("x"), [F.col("v"), F.col("v") / 2, F.col("v") / 4], F.col("dt"))
    return m.select("id", F.round("t", 6).alias("t"), F.round(pos, 6).alias("pos"), F.round(scalar.opacity_over_time(F.lit(255.0), F.col("dt"), F.lit(0.3)), 6).alias("alpha"))
