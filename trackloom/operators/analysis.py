"""Measurements that decide how a sequence is coded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalar import quantize


def displacement_static(df: DataFrame, channels: list[str], limits: list[float], flag: str | None = None) -> DataFrame:
    """(limit, [flag], n, frac): the share of entities that never move further than a limit from their first frame."""
    first = df.groupBy("entity").agg(*(F.min_by(c, "frame").alias(f"f_{c}") for c in channels))
    d = df.join(first, "entity").select("entity", *([flag] if flag else []), F.sqrt(sum((F.pow(F.col(c) - F.col(f"f_{c}"), 2) for c in channels[1:]), F.pow(F.col(channels[0]) - F.col(f"f_{channels[0]}"), 2))).alias("d"))
    far = d.groupBy("entity", *([flag] if flag else [])).agg(F.max("d").alias("far"))
    each = far.select("*", F.explode(F.array(*(F.lit(float(x)) for x in limits))).alias("limit"))
    return each.groupBy("limit", *([flag] if flag else [])).agg(F.count("*").alias("n"), F.round(F.avg((F.col("far") <= F.col("limit")).cast("int")), 6).alias("frac"))


def windowed_static(df: DataFrame, channels: list[str], widths: list[int], bounds: list[int]) -> DataFrame:
    """(width, bound, n, frac): the share of (entity, window of frames) whose range stays within twice a bound on every channel."""
    w = df.select("*", F.explode(F.array(*(F.lit(x).cast("bigint") for x in widths))).alias("width"))
    g = w.groupBy("width", "entity", F.floor(F.col("frame") / F.col("width")).alias("k")).agg(F.greatest(*(F.max(c) - F.min(c) for c in channels)).alias("span") if len(channels) > 1 else (F.max(channels[0]) - F.min(channels[0])).alias("span"))
    e = g.select("*", F.explode(F.array(*(F.lit(x).cast("bigint") for x in bounds))).alias("bound"))
    return e.groupBy("width", "bound").agg(F.count("*").alias("n"), F.round(F.avg((F.col("span") <= 2 * F.col("bound")).cast("int")), 6).alias("frac"))


def temporal_std(df: DataFrame, v: str) -> DataFrame:
    """(p25, p50, p75, p95) of the entities' standard deviations over time."""
    s = df.groupBy("entity").agg(F.stddev_pop(v).alias("s"))
    return s.agg(*(F.round(F.percentile("s", p / 100), 6).alias(f"p{p}") for p in (25, 50, 75, 95)))


def lag1(df: DataFrame, v: str) -> DataFrame:
    """(pairs, autocorr): lag-1 autocorrelation of the changes, pooled over entities."""
    w = Window.partitionBy("entity").orderBy("frame")
    d = df.select("entity", "frame", (F.col(v) - F.lag(v).over(w)).alias("d")).where("d is not null")
    p = d.select(F.col("d"), F.lag("d").over(w).alias("p"))
    return p.agg(F.count("p").alias("pairs"), F.round(F.sum(F.col("d") * F.col("p")) / F.sum(F.when(F.col("p").isNotNull(), F.col("d") * F.col("d"))), 6).alias("autocorr"))


def frame_mean_range(df: DataFrame, v: str) -> DataFrame:
    """(frames, mean_range): how far the frames' means lie apart."""
    return df.groupBy("frame").agg(F.avg(v).alias("m")).agg(F.count("*").alias("frames"), F.round(F.max("m") - F.min("m"), 6).alias("mean_range"))


def frame_median_offset(df: DataFrame, channels: list[str]) -> DataFrame:
    """(frame, off_c): the median change from each entity's first frame."""
    first = df.groupBy("entity").agg(*(F.min_by(c, "frame").alias(f"f_{c}") for c in channels))
    return df.join(first, "entity").groupBy("frame").agg(*(F.round(F.percentile(F.col(c) - F.col(f"f_{c}"), 0.5), 6).alias(f"off_{c}") for c in channels))


def remove_offset(df: DataFrame, v: str) -> DataFrame:
    """df with the whole frames' offsets taken out of a channel (rounded), a row a frame being broadcast."""
    off = frame_median_offset(df, [v])
    return df.join(F.broadcast(off), "frame").withColumn(v, F.col(v) - F.round(f"off_{v}").cast("bigint")).drop(f"off_{v}")


def delta_report(df: DataFrame, v: str, bounds: list[float]) -> DataFrame:
    """(bound, dyn, n, zero, far, entropy): the changes between bins of the entities that aren't static, by bound; entropy in bits a change."""
    w = Window.partitionBy("bound", "entity").orderBy("frame")
    each = df.select("entity", "frame", v, F.explode(F.array(*(F.lit(float(b)) for b in bounds))).alias("bound"))
    span = Window.partitionBy("bound", "entity")
    moving = each.withColumn("span", F.max(v).over(span) - F.min(v).over(span)).where(F.col("span") > 2 * F.col("bound"))
    d = moving.select("bound", "entity", quantize(F.col(v), 2 * F.col("bound")).alias("q"), "frame")
    d = d.select("bound", "entity", (F.col("q") - F.lag("q").over(w)).alias("d"))
    dyn = d.groupBy("bound").agg(F.count_distinct("entity").alias("dyn"))
    h = d.where("d is not null").groupBy("bound", "d").agg(F.count("*").alias("c"))
    out = h.groupBy("bound").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("d") == 0, F.col("c")).otherwise(0)).alias("zero"), F.sum(F.when(F.abs("d") > 15, F.col("c")).otherwise(0)).alias("far"), F.sum(F.col("c") * F.log2("c")).alias("clog"))
    return out.join(F.broadcast(dyn), "bound").select("bound", "dyn", "n", "zero", "far", F.round(F.log2("n") - F.col("clog") / F.col("n"), 6).alias("entropy"))


def sweep(df: DataFrame, channels: list[str], bounds: list[int], gops: list[int]) -> DataFrame:
    """(bound, gop, symbols, entropy_bytes): the order-0 size of every configuration, in one plan."""
    grid = F.explode(F.array(*(F.struct(F.lit(b).cast("bigint").alias("bound"), F.lit(g).cast("bigint").alias("gop")) for b in bounds for g in gops)))
    v = df.select("entity", "frame", F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(c).alias("v")) for c in channels))).alias("x")).select("entity", "frame", "x.attr", "x.v")
    each = v.select("*", grid.alias("c")).select("entity", "frame", "attr", "c.bound", "c.gop", F.floor((F.col("v") + F.col("c.bound")) / (2.0 * F.col("c.bound") + 1)).cast("bigint").alias("q"))
    w = Window.partitionBy("bound", "gop", "attr", "entity").orderBy("frame")
    prev = F.when(F.col("frame") % F.col("gop") == 0, F.lit(0)).otherwise(F.lag("q").over(w))
    s = each.select("bound", "gop", "attr", F.when(F.col("frame") % F.col("gop") == 0, 0).otherwise(1).alias("kind"), (F.col("q") - prev).alias("d"))
    h = s.groupBy("bound", "gop", "attr", "kind", "d").agg(F.count("*").alias("n"))
    t = h.groupBy("bound", "gop", "attr", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    return t.groupBy("bound", "gop").agg(F.sum("n").alias("symbols"), F.round(F.sum((F.col("n") * F.log2("n") - F.col("nlog")) / 8), 6).alias("entropy_bytes"))


def buckets(df: DataFrame, v: str, edges: list[float]) -> DataFrame:
    """(n, b0, b1, ...): the shares of values below each edge (and not below the one before), and of the rest."""
    low = [None, *edges]
    high = [*edges, None]
    def inside(a, b):
        c = F.lit(True)
        if a is not None:
            c = c & (F.col(v) >= a)
        if b is not None:
            c = c & (F.col(v) < b)
        return F.round(F.avg(c.cast("int")), 6)
    return df.agg(F.count(v).alias("n"), *(inside(a, b).alias(f"b{k}") for k, (a, b) in enumerate(zip(low, high))))


def rollup(streams: DataFrame) -> DataFrame:
    """(attr, kind, elems, raw_bytes): sums by stream category, by attribute, and in all (nulls)."""
    return streams.rollup("attr", "kind").agg(F.sum("elems").alias("elems"), F.sum("raw_bytes").alias("raw_bytes"))


def rates(streams: DataFrame, frames: int, entities: int, input_bytes: int) -> DataFrame:
    t = streams.agg(F.sum("raw_bytes").alias("out_bytes"))
    return t.select("out_bytes", F.round(F.lit(float(input_bytes)) / F.col("out_bytes"), 6).alias("ratio"), F.round(F.col("out_bytes") / F.lit(float(frames)), 6).alias("bytes_per_frame"), F.round(F.col("out_bytes") / F.lit(float(frames * entities)), 6).alias("bytes_per_point"))
