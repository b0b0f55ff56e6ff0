"""The codec's operators over track views of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalar
from trackloom.functions.ordering import neighbours, running_sums
from trackloom.operators import analysis, classify, decode, hold, symbols, tracks
from trackloom.plans.registry import EMB, EV, GOP, HELD, LI, PLANES, SYMBOLS, query
from trackloom.operators.tracks import emb_splat, ev_track, li_track

CH = ["c0", "c1", "c2"]


def held(spark, sf_dir) -> DataFrame:
    return hold.stateless(ev_track(spark, sf_dir), ["v"], 4.0, False).withColumnRenamed("bin_v", "b")


def syms(spark, sf_dir) -> DataFrame:
    return symbols.gop_symbols(held(spark, sf_dir), ["b"], GOP)


def long(spark, sf_dir) -> DataFrame:
    return symbols.long_symbols(syms(spark, sf_dir), ["b"])


@query(f"WITH {EV} SELECT entity, frame, round(v / 4.0)::BIGINT AS bin_v FROM ev")
def quantize_float(spark, sf_dir):
    return hold.stateless(ev_track(spark, sf_dir), ["v"], 4.0, False)


@query(f"WITH {LI} SELECT entity, frame, floor((c0 - 25 + 4) / 9.0)::BIGINT AS bin_c FROM li")
def quantize_int(spark, sf_dir):
    li = li_track(spark, sf_dir).select("entity", "frame", (F.col("c0") - 25).alias("c"))
    return hold.stateless(li, ["c"], 9, True)


@query(f"WITH {HELD}, d AS (SELECT entity, frame, b - lag(b) OVER (PARTITION BY entity ORDER BY frame) AS n FROM held) SELECT entity, frame, n, (CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END)::BIGINT AS z, n AS back FROM d WHERE n IS NOT NULL")
def zigzag_roundtrip(spark, sf_dir):
    d = held(spark, sf_dir).select("entity", "frame", (F.col("b") - F.lag("b").over(Window.partitionBy("entity").orderBy("frame"))).alias("n")).where("n is not null")
    z = d.withColumn("z", scalar.zigzag(F.col("n")))
    return z.withColumn("back", scalar.unzigzag(F.col("z")))


_RANGES = "r AS (SELECT entity, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, arg_min({c}, frame) AS v0_{c}" for c in CH) + " FROM li GROUP BY entity)"


def ranges(spark, sf_dir):
    return classify.minmax(li_track(spark, sf_dir), CH)


@query(f"WITH {LI}, {_RANGES} SELECT * FROM r")
def track_minmax(spark, sf_dir):
    return ranges(spark, sf_dir)


@query(f"WITH {LI}, {_RANGES} SELECT " + ", ".join(f"min(lo_{c}) AS min_{c}, max(hi_{c}) AS max_{c}" for c in CH) + " FROM r")
def aabb(spark, sf_dir):
    return classify.aabb(ranges(spark, sf_dir), CH)


@query(f"""WITH {EV}, r AS (SELECT entity, min(v) AS lo, max(v) AS hi, arg_min(v, frame) AS v0 FROM ev GROUP BY entity),
c AS (SELECT *, round((lo + hi) / 2 / 90.0)::BIGINT AS cand FROM r),
s AS (SELECT *, hi - 90.0 - 1e-9 <= cand * 90.0 AND cand * 90.0 <= lo + 90.0 + 1e-9 AS static FROM c)
SELECT entity, static, CASE WHEN static THEN cand ELSE round(v0 / 90.0)::BIGINT END AS base_v FROM s""")
def classify_float(spark, sf_dir):
    r = classify.minmax(ev_track(spark, sf_dir), ["v"])
    return classify.static_float(r, ["v"], 90.0, 90.0).select("entity", "static", "base_v")


def _static(c, b):
    return f"(hi_{c} - {b} <= (lo_{c} + hi_{c}) >> 1 AND (lo_{c} + hi_{c}) >> 1 <= lo_{c} + {b})"


@query(f"WITH {LI}, {_RANGES}, s AS (SELECT *, {_static('c1', 5)} AND {_static('c2', 5)} AS static FROM r) SELECT entity, static, " + ", ".join(f"CASE WHEN static THEN (lo_{c} + hi_{c}) >> 1 ELSE v0_{c} END AS base_{c}" for c in ("c1", "c2")) + " FROM s")
def classify_int(spark, sf_dir):
    return classify.static_int(ranges(spark, sf_dir), ["c1", "c2"], 5).select("entity", "static", "base_c1", "base_c2")


BOUNDS = (23, 4, 3)
_META = f"{LI}, {_RANGES}, m AS (SELECT entity, v0_c0, v0_c1, v0_c2, " + ", ".join(f"{_static(c, b)} AS st_{c}" for c, b in zip(CH, BOUNDS)) + " FROM r), k AS (SELECT *, " + " + ".join(f"CASE WHEN st_{c} THEN 0 ELSE {1 << i} END" for i, c in enumerate(CH)) + " AS mask FROM m)"


def meta(spark, sf_dir):
    r = ranges(spark, sf_dir)
    for c, b in zip(CH, BOUNDS):
        r = classify.static_int(r, [c], b, f"st_{c}")
    return r.select("entity", *(f"v0_{c}" for c in CH), *(f"st_{c}" for c in CH))


@query(f"WITH {_META} SELECT " + ", ".join(f"round(avg(st_{c}::INT), 6) AS frac_st_{c}" for c in CH) + ", " + ", ".join(f"count(*) FILTER (NOT st_{c}) AS dyn_st_{c}" for c in CH) + " FROM k")
def static_fractions(spark, sf_dir):
    return classify.static_fractions(meta(spark, sf_dir), [f"st_{c}" for c in CH])


@query(f"WITH {_META} SELECT mask::BIGINT AS mask, count(*) AS n FROM k GROUP BY mask")
def dynamism_groups(spark, sf_dir):
    m = meta(spark, sf_dir)
    return classify.groups(m.withColumn("mask", scalar.mask_bits(*(~F.col(f"st_{c}") for c in CH))))


def _spread(x):
    x = f"({x} & {0x1FFFFF})"
    for s, m in scalar.SPREAD:
        x = f"(({x} | (({x} & {m >> s}) << {s})) & {m})"
    return x


def _spread_steps(columns):
    """The spreading as one select a step, so that the text stays short."""
    out, last = [], "k"
    for n, (s, m) in enumerate(scalar.SPREAD):
        cols = ", ".join(f"((e{c} | ((e{c} & {m >> s}) << {s})) & {m}) AS e{c}" for c in columns)
        source = last if n else f"(SELECT *, {', '.join(f'least(v0_{c}, 2097151)::BIGINT AS e{c}' for c in columns)} FROM k)"
        out.append(f"x{n} AS (SELECT * EXCLUDE ({', '.join('e' + c for c in columns)}), {cols} FROM {source})")
        last = f"x{n}"
    return ", ".join(out), last


_STEPS, _LAST = _spread_steps(CH)
_KEYED = f"{_META}, {_STEPS}, keyed AS (SELECT *, ec0 | (ec1 << 1) | (ec2 << 2) AS code, (mask::BIGINT << 58) | ((ec0 | (ec1 << 1) | (ec2 << 2)) & {(1 << 58) - 1}) AS key FROM {_LAST}), o AS (SELECT *, row_number() OVER (ORDER BY key, entity) - 1 AS ord FROM keyed)"


def ordered(spark, sf_dir):
    return classify.ordered(meta(spark, sf_dir), [f"st_{c}" for c in CH], [f"v0_{c}" for c in CH], [0, 0, 0], 1)


@query(f"WITH {_KEYED} SELECT entity, code, key FROM keyed")
def morton_key(spark, sf_dir):
    m = meta(spark, sf_dir)
    code = scalar.morton(*(scalar.cell(F.col(f"v0_{c}"), F.lit(0), 1) for c in CH))
    return m.select("entity", code.alias("code"), scalar.sort_key(scalar.mask_bits(*(~F.col(f"st_{c}") for c in CH)), code).alias("key"))


@query(f"WITH {_KEYED} SELECT entity, ord FROM o")
def morton_order(spark, sf_dir):
    return ordered(spark, sf_dir).select("entity", "ord")


@query(f"WITH {_KEYED} SELECT floor(ord / 8)::BIGINT AS byte_no, sum(CASE WHEN st_c0 THEN 1 << (7 - ord % 8)::INT ELSE 0 END)::BIGINT AS byte FROM o GROUP BY 1")
def mask_bitmap(spark, sf_dir):
    return classify.bitmap(ordered(spark, sf_dir), "st_c0")


@query(f"WITH {_KEYED} SELECT ord, st_c0 AS flag FROM o")
def mask_unbitmap(spark, sf_dir):
    o = ordered(spark, sf_dir)
    return classify.unbitmap(classify.bitmap(o, "st_c0"), o.count())


@query(f"WITH {_KEYED}, s AS (SELECT ord, v0_c0 - coalesce(lag(v0_c0) OVER (ORDER BY ord), 0) AS n FROM o) SELECT ord, (CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END)::BIGINT AS sym FROM s")
def spatial_delta(spark, sf_dir):
    return _spatial(spark, sf_dir).select("ord", "sym")


def _spatial(spark, sf_dir):
    o = ordered(spark, sf_dir).select("ord", "v0_c0")
    return neighbours(o, "ord", ["v0_c0"]).select("ord", scalar.zigzag(F.col("v0_c0") - F.coalesce("prev_v0_c0", F.lit(0))).alias("sym"))


@query(f"WITH {_KEYED} SELECT ord, v0_c0 AS value FROM o")
def spatial_delta_inverse(spark, sf_dir):
    d = _spatial(spark, sf_dir).select("ord", scalar.unzigzag(F.col("sym")).alias("d"))
    return running_sums(d, "ord", ["d"], 512).select("ord", F.col("sum_d").alias("value"))


def _held(track, values, step, bound, integer):
    """Recursive SQL of a hold."""
    fresh = {c: f"floor((e.{c} + {step // 2}) / {step}.0)::BIGINT" if integer else f"round(e.{c} / {step})::BIGINT" for c in values}
    left = " OR ".join(f"abs(e.{c} - h.bin_{c} * {step}) > {bound}" for c in values)
    first = ", ".join(f"{fresh[c]} AS bin_{c}" for c in values)
    kept = ", ".join(f"CASE WHEN {left} THEN {fresh[c]} ELSE h.bin_{c} END" for c in values)
    name = track[: track.index(" ")]
    return f"WITH RECURSIVE {track}, h AS (SELECT e.entity, e.frame, {first} FROM {name} e WHERE frame = 0 UNION ALL SELECT e.entity, e.frame, {kept} FROM h JOIN {name} e ON e.entity = h.entity AND e.frame = h.frame + 1) SELECT * FROM h"


@query(_held(EV, ["v"], 4.0, 2.0, False))
def hold_scalar(spark, sf_dir):
    return hold.hold(ev_track(spark, sf_dir), ["v"], 4.0, 2.0, False)


@query(_held(EV, ["v"], 4.0, 10.0, False))
def hold_wide(spark, sf_dir):
    return hold.hold(ev_track(spark, sf_dir), ["v"], 4.0, 10.0, False)


@query(_held(LI, CH, 9, 16, True))
def hold_vector(spark, sf_dir):
    return hold.hold(li_track(spark, sf_dir), CH, 9, 16, True)


@query(_held(LI, CH, 9, 16, True))
def hold_in_buckets(spark, sf_dir):
    return hold.hold_buckets(li_track(spark, sf_dir), CH, 9, 16, True)


@query(f"WITH {LI} SELECT entity, frame, " + ", ".join(f"floor(({c} + 4) / 9.0)::BIGINT AS bin_{c}" for c in CH) + " FROM li")
def hold_is_quantize(spark, sf_dir):
    """At bound = (step - 1) / 2 holding gives the memoryless bins."""
    return hold.hold(li_track(spark, sf_dir), CH, 9, 4, True)


@query(f"WITH {SYMBOLS} SELECT entity, gop, frame, sym FROM sy WHERE kind = 0")
def gop_keys(spark, sf_dir):
    return syms(spark, sf_dir).where("kind = 0").select("entity", "gop", "frame", F.col("sym_b").alias("sym"))


@query(f"WITH {SYMBOLS} SELECT entity, gop, frame, sym FROM sy WHERE kind = 1")
def gop_deltas(spark, sf_dir):
    return syms(spark, sf_dir).where("kind = 1").select("entity", "gop", "frame", F.col("sym_b").alias("sym"))


@query(f"WITH {HELD} SELECT entity, frame, b FROM held")
def gop_prefix_decode(spark, sf_dir):
    return symbols.prefix_decode(syms(spark, sf_dir), ["b"])


@query(f"WITH {HELD} SELECT count(*) AS rows, round(max(abs(v - b * 4.0)), 6) AS max_err, true AS ok FROM ev JOIN held USING (entity, frame)")
def verify_max_error(spark, sf_dir):
    back = symbols.prefix_decode(syms(spark, sf_dir), ["b"]).select("entity", "frame", (F.col("b") * 4.0).alias("back"))
    return decode.max_error(ev_track(spark, sf_dir), back, [("v", "back")], 2.0, False)


@query(f"""WITH {LI}, {_RANGES}, b AS (SELECT entity, {_static('c0', 23)} AS st, CASE WHEN {_static('c0', 23)} THEN (lo_c0 + hi_c0) >> 1 ELSE v0_c0 END AS base FROM r)
SELECT li.entity, li.frame, least(greatest(CASE WHEN st THEN base ELSE floor((c0 + 23) / 47.0)::BIGINT * 47 END, 0), 255)::BIGINT AS shown FROM li JOIN b USING (entity)""")
def static_overlay(spark, sf_dir):
    """Static bases overlaid by the dynamic entities' bins, as a decoder shows them; each entity in the frames that it has."""
    li = li_track(spark, sf_dir)
    s = classify.static_int(ranges(spark, sf_dir), ["c0"], 23)
    dynamic = hold.stateless(li.join(s.where("not static").select("entity"), "entity", "left_semi"), ["c0"], 47, True)
    shown = decode.overlay(s.select("entity", "base_c0"), dynamic, li.select("entity", "frame"), ["c0"], 1, 47)
    return shown.select("entity", "frame", decode.dequantize("rgb", F.col("value_c0"), 1).cast("bigint").alias("shown"))


@query(f"WITH {HELD} SELECT entity, frame, (b * 4.0)::DOUBLE AS pos, round(exp(b * 0.01), 6) AS scale, least(greatest(b * 9, 0), 255)::BIGINT AS rgb, least(greatest(b * 3, -128), 127)::BIGINT AS rot FROM held")
def dequantize(spark, sf_dir):
    b = F.col("b")
    return held(spark, sf_dir).select("entity", "frame", decode.dequantize("pos", b, 4.0).alias("pos"), F.round(decode.dequantize("scale", b, 0.01), 6).alias("scale"), decode.dequantize("rgb", b, 9).cast("bigint").alias("rgb"), decode.dequantize("rot", b, 3).cast("bigint").alias("rot"))


@query(f"WITH {EV}, f AS (SELECT frame, count(*) AS len FROM ev GROUP BY frame), g AS (SELECT (frame // {GOP})::BIGINT AS gop, min(frame) AS f0, max(frame) AS f1, sum(len)::BIGINT AS len FROM f GROUP BY 1) SELECT gop, f0, f1, round(f0 / 20.0, 6) AS t0, round(f1 / 20.0, 6) AS t1, len, coalesce(sum(len) OVER (ORDER BY gop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM g")
def gop_index(spark, sf_dir):
    return _index(spark, sf_dir)


def _index(spark, sf_dir):
    return symbols.gop_index(ev_track(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("len")), GOP, 20.0)


@query(f"WITH {EV} SELECT frame, (frame // {GOP})::BIGINT AS gop, count(*) AS n FROM ev GROUP BY ALL")
def frame_to_gop(spark, sf_dir):
    """An interval join of frames to the spans of groups; the index has a row a group."""
    n = ev_track(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"))
    g = _index(spark, sf_dir).select("gop", "f0", "f1")
    return n.join(g, F.col("frame").between(F.col("f0"), F.col("f1"))).select("frame", "gop", "n")


@query(f"WITH {SYMBOLS} SELECT gop, attr, kind, count(*) AS elems, (CASE WHEN max(sym) < 256 THEN 1 WHEN max(sym) < 65536 THEN 2 ELSE 4 END)::BIGINT AS width, (count(*) * CASE WHEN max(sym) < 256 THEN 1 WHEN max(sym) < 65536 THEN 2 ELSE 4 END)::BIGINT AS raw_bytes FROM sy GROUP BY ALL")
def sym_width(spark, sf_dir):
    return symbols.widths(long(spark, sf_dir))


@query(f"WITH {PLANES} SELECT gop, attr, kind, plane, byte, count(*) AS n FROM pl GROUP BY ALL")
def byte_planes(spark, sf_dir):
    return symbols.byte_planes(long(spark, sf_dir))


@query(f"WITH {PLANES} SELECT gop, attr, kind, byte, count(*) AS n FROM pl GROUP BY ALL")
def plane_histogram(spark, sf_dir):
    return symbols.byte_planes(long(spark, sf_dir)).groupBy("gop", "attr", "kind", "byte").agg(F.sum("n").alias("n"))


def _entropy(counts, keys):
    return f"SELECT {keys}, sum(n)::BIGINT AS n, round((sum(n) * log2(sum(n)) - sum(n * log2(n))) / 8, 6) AS entropy_bytes FROM ({counts}) GROUP BY ALL"


@query(f"WITH {PLANES} " + _entropy("SELECT gop, attr, kind, byte, count(*) AS n FROM pl GROUP BY ALL", "gop, attr, kind"))
def plane_entropy(spark, sf_dir):
    return symbols.plane_entropy(long(spark, sf_dir))


@query(f"WITH {SYMBOLS} " + _entropy("SELECT gop, attr, kind, sym, count(*) AS n FROM sy GROUP BY ALL", "gop, attr, kind"))
def symbol_entropy(spark, sf_dir):
    return symbols.symbol_entropy(long(spark, sf_dir))


_STREAMS = "st AS (SELECT gop, attr, kind, count(*) AS elems, count(*) * CASE WHEN max(sym) < 256 THEN 1 WHEN max(sym) < 65536 THEN 2 ELSE 4 END AS raw_bytes FROM sy GROUP BY ALL)"


@query(f"WITH {SYMBOLS}, {_STREAMS} SELECT attr, kind, sum(elems)::BIGINT AS elems, sum(raw_bytes)::BIGINT AS raw_bytes FROM st GROUP BY ROLLUP (attr, kind)")
def stream_rollup(spark, sf_dir):
    return analysis.rollup(symbols.widths(long(spark, sf_dir)))


@query(f"WITH {SYMBOLS}, {_STREAMS}, us AS (SELECT count(*) AS n FROM events GROUP BY user_id), sz AS (SELECT sum(n) * 32.0 AS input, max(n) AS frames, count(*) AS entities FROM us)"
       " SELECT sum(raw_bytes)::BIGINT AS out_bytes, round(any_value(input) / sum(raw_bytes), 6) AS ratio, round(sum(raw_bytes) / any_value(frames)::DOUBLE, 6) AS bytes_per_frame, round(sum(raw_bytes) / any_value(frames * entities)::DOUBLE, 6) AS bytes_per_point FROM st, sz")
def stream_rates(spark, sf_dir):
    n = ev_track(spark, sf_dir).agg(F.count_distinct("frame").alias("frames"), F.count_distinct("entity").alias("entities"), (F.count("*") * 32).alias("input_bytes")).first()
    return analysis.rates(symbols.widths(long(spark, sf_dir)), n.frames, n.entities, n.input_bytes)


_D5 = ", ".join(f"list_sort([coalesce(lag({c}, 2) OVER w, first({c}) OVER f), coalesce(lag({c}) OVER w, first({c}) OVER f), {c}, coalesce(lead({c}) OVER w, last({c}) OVER f), coalesce(lead({c}, 2) OVER w, last({c}) OVER f)])[3] AS {c}_ref" for c in ("c0",))
_DENOISED = f"{LI}, dn AS (SELECT *, {_D5} FROM li WINDOW w AS (PARTITION BY entity ORDER BY frame), f AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query(f"WITH {_DENOISED} SELECT entity, frame, c0, c0_ref FROM dn")
def denoise_median5(spark, sf_dir):
    return tracks.denoise(li_track(spark, sf_dir), ["c0"]).select("entity", "frame", "c0", "c0_ref")


@query(f"WITH {_DENOISED}, h AS (SELECT abs(c0 - c0_ref) AS d, count(*) AS n FROM dn GROUP BY 1), l AS (SELECT d, n, sum(n) OVER (ORDER BY d) AS upto, sum(n) OVER () AS total FROM h) SELECT round(sum(d * n) / max(total), 6) AS mean_dev, min(d) FILTER (upto >= 0.99 * total) AS p99_dev FROM l")
def denoise_stats(spark, sf_dir):
    return tracks.denoise_stats(li_track(spark, sf_dir), ["c0"])


_Q = [f"q{k}" for k in range(4)]
_CANON = f"""WITH RECURSIVE {EMB}, n AS MATERIALIZED (SELECT label AS entity, row_number() OVER (PARTITION BY label ORDER BY splat_id) - 1 AS frame, q0, q1, q2, q3 FROM emb),
c AS (SELECT * FROM n WHERE frame = 0 UNION ALL SELECT n.entity, n.frame, {", ".join(f"CASE WHEN {' + '.join(f'n.{p} * c.{p}' for p in _Q)} < 0 THEN least(-n.{q}, 127) ELSE n.{q} END" for q in _Q)} FROM c JOIN n ON n.entity = c.entity AND n.frame = c.frame + 1) SELECT * FROM c"""


def _quats(spark, sf_dir):
    e = emb_splat(spark, sf_dir)
    frame = F.row_number().over(Window.partitionBy("label").orderBy("splat_id")) - 1
    return e.select("label", frame.cast("bigint").alias("frame"), *_Q)


@query(_CANON)
def quat_canonicalize(spark, sf_dir):
    return tracks.canonicalize(_quats(spark, sf_dir), "label", "frame")


@query(_CANON)
def quat_canonicalize_sql(spark, sf_dir):
    return tracks.canonicalize_sql(_quats(spark, sf_dir), "label", "frame")


@query(f"WITH {HELD}, c AS (SELECT entity, frame, b - lag(b) OVER (PARTITION BY entity ORDER BY frame) AS delta FROM held) SELECT entity, frame, delta, entity - coalesce(lag(entity) OVER (PARTITION BY frame ORDER BY entity), 0) AS gap FROM c WHERE delta <> 0")
def sparse_events(spark, sf_dir):
    return symbols.sparse_events(held(spark, sf_dir), "b").select("entity", "frame", "delta", "gap")


@query(f"WITH {LI}, e AS (SELECT *, least(greatest(4, floor(2.0 / greatest(c2 / 8.0, 1e-6))::BIGINT), 64) AS bound FROM li) SELECT entity, frame, bound, floor((c0 + bound) / (2.0 * bound + 1))::BIGINT AS bin FROM e")
def weighted_bounds(spark, sf_dir):
    e = li_track(spark, sf_dir).withColumn("bound", scalar.weighted_bound(4, 2.0, F.col("c2") / 8.0))
    return e.select("entity", "frame", "bound", F.floor((F.col("c0") + F.col("bound")) / (2.0 * F.col("bound") + 1)).cast("bigint").alias("bin"))


@query(f"WITH {LI}, a AS (SELECT *, c0 - c2 AS co, c2 + ((c0 - c2) >> 1) AS t FROM li) SELECT entity, frame, t + ((c1 - t) >> 1) AS y, co, c1 - t AS cg, c0 AS r, c1 AS g, c2 AS b FROM a")
def ycocg(spark, sf_dir):
    li = li_track(spark, sf_dir)
    y, co, cg = scalar.ycocg(*(F.col(c) for c in CH))
    out = li.select("entity", "frame", y.alias("y"), co.alias("co"), cg.alias("cg"))
    return out.select("*", *(c.alias(n) for n, c in zip("rgb", scalar.un_ycocg(F.col("y"), F.col("co"), F.col("cg")))))


@query(f"WITH {SYMBOLS}, k AS (SELECT * FROM sy WHERE kind = 0 AND gop = 2), h AS (SELECT entity, frame, b FROM held WHERE frame = 25) SELECT h.entity, CASE WHEN k.sym % 2 = 0 THEN k.sym // 2 ELSE -((k.sym + 1) // 2) END AS approximate, h.b AS exact FROM h JOIN k USING (entity)")
def keys_first(spark, sf_dir):
    """A seek to frame 25: the group's key at once, then the exact bins rolled forward from it."""
    s = syms(spark, sf_dir).where("gop = 2 and frame <= 25")
    exact = symbols.prefix_decode(s, ["b"]).where("frame = 25").select("entity", F.col("b").alias("exact"))
    near = s.where("kind = 0").select("entity", scalar.unzigzag(F.col("sym_b")).alias("approximate"))
    return near.join(exact, "entity").select("entity", "approximate", "exact")


@query(f"WITH {EV}, g AS (SELECT DISTINCT (frame // {GOP})::BIGINT AS gop FROM ev), r AS (SELECT gop FROM g WHERE gop % 3 = 0), n AS (SELECT count(*) AS n FROM g) SELECT gop, row_number() OVER (ORDER BY (gop - 4 + n) % n) AS turn FROM g, n WHERE gop NOT IN (SELECT gop FROM r)")
def prefetch_order(spark, sf_dir):
    """Groups that aren't ready, in a circle from group 4 on."""
    g = _index(spark, sf_dir).select("gop")
    ready = g.where("gop % 3 = 0")
    n = g.count()
    turn = F.row_number().over(Window.orderBy(F.pmod(F.col("gop") - 4, F.lit(n))))  # a row a group
    return g.join(ready, "gop", "left_anti").select("gop", turn.cast("bigint").alias("turn"))


@query(f"WITH {SYMBOLS}, gs AS (SELECT DISTINCT gop FROM sy), r AS (SELECT gop, gop % 3 <> 1 AS ready FROM gs), s AS (SELECT gop, ready, gop - row_number() OVER (PARTITION BY ready ORDER BY gop) AS run FROM r) SELECT min(gop) AS first, max(gop) AS last, count(*) AS n FROM s WHERE ready GROUP BY run")
def buffered_ranges(spark, sf_dir):
    """Runs of groups that are ready."""
    r = _index(spark, sf_dir).select("gop").where("gop % 3 <> 1")
    run = F.col("gop") - F.row_number().over(Window.orderBy("gop"))  # a row a group
    return r.withColumn("run", run).groupBy("run").agg(F.min("gop").alias("first"), F.max("gop").alias("last"), F.count("*").alias("n")).drop("run")


@query(f"WITH {_KEYED}, f AS (SELECT min((2 * ord) >> 11) AS row FROM o WHERE mask <> 0) SELECT entity, ord, ((2 * ord) >> 11)::BIGINT AS row FROM o, f WHERE ((2 * ord) >> 11) >= f.row")
def upload_band(spark, sf_dir):
    """Entities in texture rows at or after that of the first dynamic one."""
    o = ordered(spark, sf_dir).select("entity", "ord", "mask", scalar.texel_row(F.col("ord")).cast("bigint").alias("row"))
    first = o.where("mask <> 0").agg(F.min("row").alias("first"))
    return o.join(F.broadcast(first), F.col("row") >= F.col("first")).select("entity", "ord", "row")  # first: one row


@query(f"WITH {_KEYED} SELECT o.ord, li.frame, li.c0, li.c1, li.c2 FROM o JOIN li USING (entity)")
def file_order_gather(spark, sf_dir):
    """Original frames in the order of the file: an equi-join with the permutation."""
    o = ordered(spark, sf_dir).select("entity", "ord")
    return li_track(spark, sf_dir).join(o, "entity").select("ord", "frame", *CH)


@query(f"WITH {SYMBOLS} SELECT gop, attr, kind, count(*) AS elems FROM sy GROUP BY ALL")
def required_streams(spark, sf_dir):
    """Streams looked up by group, attribute and kind; a missing one would stop the job."""
    s = long(spark, sf_dir)
    wanted = s.select("gop", "attr", "kind").distinct()
    return decode.require_complete(wanted, symbols.widths(s).select("gop", "attr", "kind", "elems"), ["gop", "attr", "kind"])


@query(f"WITH {_KEYED} SELECT entity, st_c0 AS pos, st_c1 AS rot, mask::BIGINT AS mask FROM o WHERE NOT (st_c0 AND st_c1)")
def recompute_set(spark, sf_dir):
    """Entities with a dynamic rotation or scale: the union of two index sets."""
    return ordered(spark, sf_dir).where("not (st_c0 and st_c1)").select("entity", F.col("st_c0").alias("pos"), F.col("st_c1").alias("rot"), "mask")
