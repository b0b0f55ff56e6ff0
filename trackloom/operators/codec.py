"""encode, decode, verify and info over whole sequences of points.

Input: rows (frame, splat_id, x, y, z, sx, sy, sz, r, g, b, a, q0 .. q3) as the `splat` source gives them. Values are classified, ordered, quantized and differenced
by DataFrame plans; a task packs one stream of a frame group; the driver writes the file chunk by chunk, never holding more than one chunk and the
static section (a few numbers a point).
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.config import ATTRS, CHANNELS, Bounds, check_gop
from trackloom.functions.arrow import unzz, zz
from trackloom.functions.scalar import log_scale, quantize, quantize_int, unzigzag, zigzag
from trackloom.operators import classify, hold, tracks
from trackloom.operators.decode import VERIFY_SLACK
from trackloom.sources import container

#: Columns of each attribute, and the order of the static streams' bases.
PARTS = {"pos": ("x", "y", "z"), "rot": ("q0", "q1", "q2", "q3"), "rgb": ("r", "g", "b"), "alpha": ("a",), "scale": ("l0", "l1", "l2")}
FLOATS = ("pos", "scale")
RECORD_BYTES = 32


def signal(splats: DataFrame, denoise: bool = False) -> DataFrame:
    """(entity, frame, channels): the signal that bounds refer to: log scales, centred quaternions of continuous sign, colours denoised if wanted."""
    rows = splats.select(
        F.col("splat_id").cast("bigint").alias("entity"), F.col("frame").cast("bigint").alias("frame"), *(F.col(c).cast("double").alias(c) for c in "xyz"),
        *(log_scale(F.col(s).cast("double")).cast("float").cast("double").alias(f"l{k}") for k, s in enumerate(("sx", "sy", "sz"))),
        *(F.col(c).cast("bigint").alias(c) for c in "rgba"), *((F.col(f"q{k}") - 128).cast("bigint").alias(f"q{k}") for k in range(4)),
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        q = list(PARTS["rot"])
        pdf = pdf.sort_values(["frame", "entity"])
        n = pdf["frame"].nunique()
        pdf[q] = tracks.canonical_signs(pdf[q].to_numpy(np.int64).reshape(n, -1, 4)).reshape(-1, 4)
        return pdf.drop(columns="bucket")

    # buckets of entities: a fold over frames runs on all of a bucket's entities at once
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(64)))
    out = bucketed.groupBy("bucket").applyInPandas(fold, rows.schema)
    if denoise:
        out = tracks.denoise(out, list("rgb")).select(*(F.col(f"{c}_ref").alias(c) if c in "rgb" else c for c in out.columns))
    return out


def front_end(sig: DataFrame, bounds: Bounds) -> tuple[DataFrame, list[float]]:
    """(meta, box): a row an entity with st_attr, base_channel, mask, ord; the bounding box of all positions."""
    channels = [c for a in ATTRS for c in PARTS[a]]
    r = classify.minmax(sig, channels)
    box = list(classify.aabb(r, list(PARTS["pos"])).first())
    for a in ATTRS:
        step, pitch, bound = bounds.of(a)
        r = classify.static_float(r, list(PARTS[a]), bound, pitch, f"st_{a}") if a in FLOATS else classify.static_int(r, list(PARTS[a]), bound, f"st_{a}")
    meta = classify.ordered(r, [f"st_{a}" for a in ATTRS], [f"v0_{c}" for c in PARTS["pos"]], box[0::2], bounds.steps.pos)
    return meta.select("entity", "ord", "mask", *(f"st_{a}" for a in ATTRS), *(f"base_{c}" for c in channels)), box


def attribute_bins(sig: DataFrame, meta: DataFrame, attr: str, bounds: Bounds, exact: bool) -> DataFrame:
    """(ord, frame, b array) of the entities whose attribute moves."""
    step, _, bound = bounds.of(attr)
    parts, integer = list(PARTS[attr]), attr not in FLOATS
    moving = meta.where(~F.col(f"st_{attr}")).select("entity", "ord")
    rows = sig.select("entity", "frame", *parts)
    held = hold.hold_buckets(rows.join(moving.select("entity"), "entity", "left_semi"), parts, step, bound, integer) if exact else hold.stateless(rows, parts, step, integer)
    return held.join(moving, "entity").select("ord", "frame", F.array(*(F.col(f"bin_{c}") for c in parts)).alias("b"))


def streams(sig: DataFrame, meta: DataFrame, bounds: Bounds, gop: int, level: int, exact: bool) -> DataFrame:
    """(gop, attr, kind, width, elems, raw_bytes, entropy_bytes, payload), one row a stream of a frame group."""
    w = Window.partitionBy("attr", "ord", "gop").orderBy("frame")
    every = None
    for a, k in ATTRS.items():
        d = attribute_bins(sig, meta, a, bounds, exact).select(F.lit(k).cast("bigint").alias("attr"), "ord", "frame", F.floor(F.col("frame") / gop).cast("bigint").alias("gop"), "b")
        every = d if every is None else every.unionByName(d)
    s = every.withColumn("p", F.lag("b").over(w))
    delta = F.when(F.col("p").isNull(), F.col("b")).otherwise(F.zip_with("b", "p", lambda x, y: x - y))
    s = s.select("gop", "attr", F.when(F.col("p").isNull(), container.KEY).otherwise(container.DELTA).cast("bigint").alias("kind"), "frame", "ord", F.transform(delta, zigzag).alias("z"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "ord"])
        s = container.pack_stream(int(pdf["attr"].iloc[0]), int(pdf["kind"].iloc[0]), np.concatenate(pdf["z"].to_numpy()), level)
        return pd.DataFrame([{"gop": int(pdf["gop"].iloc[0])} | s])

    return s.groupBy("gop", "attr", "kind").applyInPandas(pack, "gop long, attr long, kind long, width long, elems long, raw_bytes long, entropy_bytes double, payload binary")


def spatial_deltas(v: np.ndarray) -> np.ndarray:
    d = v.copy()
    d[1:] -= v[:-1]
    return zz(d).ravel()


def static_streams(meta: pd.DataFrame, level: int) -> list[dict]:
    """The ten streams of the static section, in the format's order."""
    raw = [(ATTRS[a], np.packbits(meta[f"st_{a}"].to_numpy(bool)).astype(np.int64)) for a in ("pos", "rot", "rgb", "alpha", "scale")]
    base = {a: meta[[f"base_{c}" for c in PARTS[a]]].to_numpy(np.int64) for a in ATTRS}
    raw += [(ATTRS["pos"], spatial_deltas(base["pos"])), (ATTRS["scale"], spatial_deltas(base["scale"])), (ATTRS["rgb"], base["rgb"].ravel()), (ATTRS["alpha"], base["alpha"].ravel()), (ATTRS["rot"], (base["rot"] + 128).ravel())]
    return [container.pack_stream(a, container.STATIC, s, level) | {"name": n} for n, (a, s) in zip(container.STATIC_NAMES, raw)]


def encode(splats: DataFrame, path: str, bounds: Bounds | None = None, gop: int = 30, level: int = 3, fps: float = 30.0, denoise: bool = False, hold_mode: str = "fast", check: bool = True, perm_path: str | None = None) -> dict:
    """Writes the container and returns the report; with check every frame is decoded again and held against the bounds."""
    bounds, gop = bounds or Bounds(), check_gop(gop)
    sig = signal(splats, denoise).cache()
    meta, box = front_end(sig, bounds)
    meta = meta.cache()
    try:
        frames, n = sig.agg(F.max("frame") + 1).first()[0], meta.count()
        if not n:
            raise ValueError("no points")
        packed = streams(sig, meta, bounds, gop, level, hold_mode == "exact").cache()
        order = meta.orderBy("ord").toPandas()
        static = static_streams(order, level)
        sizes = {r.gop: r for r in packed.groupBy("gop").agg(F.sum(F.length("payload")).alias("size"), F.count("*").alias("n")).collect()}
        n_gops = -(-frames // gop)
        spans = []
        for g in range(n_gops):
            f0, f1 = g * gop, min((g + 1) * gop, frames) - 1
            size = 2 + (container.STREAM.size * sizes[g].n + sizes[g].size if g in sizes else 0)
            spans.append({"len": int(size), "f0": f0, "f1": f1, "t0": f0 / fps, "t1": f1 / fps})
        s = bounds.steps
        header = {
            "n": n, "t": frames, "fps": fps, "gop": gop,
            "bounds": {"pos_m": bounds.pos_m, "scale_rel": bounds.scale_rel, "rgb": bounds.rgb, "alpha": bounds.alpha, "rot": bounds.rot},
            "steps": {"pos": s.pos, "base_pos": s.base_pos, "scale_log": s.scale_log, "base_scale_log": s.base_scale_log, "rgb": s.rgb, "alpha": s.alpha, "rot": s.rot},
            "dyn": {a: int((~order[f"st_{a}"]).sum()) for a in ATTRS},
            "groups": [{"mask": int(m), "count": int(c)} for m, c in order.groupby("mask", sort=True).size().items()],
            "aabb": [box[0], box[2], box[4], box[1], box[3], box[5]],
        }
        body = b"".join(container.stream_head(x) + x["payload"] for x in static)
        with open(path, "wb") as f:
            f.write(container.header_bytes(header, len(body), spans, denoise))
            f.write(body)
            for g in range(n_gops):
                rows = [r.asDict() for r in packed.where(F.col("gop") == g).orderBy("kind", "attr").collect()]
                f.write(container.chunk(rows))
            size = f.tell()
        if perm_path:
            order["entity"].to_numpy("<u4").tofile(perm_path)
        stats = [{"name": f"static.{x['name']}", "raw": x["raw_bytes"], "comp": len(x["payload"]) + container.STREAM.size, "entropy": x["entropy_bytes"]} for x in static]
        names = {v: k for k, v in ATTRS.items()}
        for r in packed.groupBy("attr", "kind").agg(F.sum("raw_bytes").alias("raw"), F.sum(F.length("payload") + container.STREAM.size).alias("comp"), F.sum("entropy_bytes").alias("entropy")).collect():
            stats.append({"name": f"dyn.{names[r.attr]}.{('key', 'delta')[r.kind]}", "raw": r.raw, "comp": r.comp, "entropy": r.entropy})
        report = {"input_bytes": frames * n * RECORD_BYTES, "output_bytes": size, "ratio": frames * n * RECORD_BYTES / size, "static": {a: float(order[f"st_{a}"].mean()) for a in ATTRS}, "streams": sorted(stats, key=lambda x: x["name"])}
        if check:
            bad = [r.attr for r in verify(splats.sparkSession, path, splats, sig=sig, meta=meta).collect() if not r.ok]
            if bad:
                raise ValueError(f"bounds don't hold for {bad}")
        return report
    finally:
        sig.unpersist()
        meta.unpersist()


def cache_key(name: str, **request) -> str:
    """A file name for a request; parameters are first moved into their limits."""
    from trackloom.config import clamp_request

    return "_".join([name, *(f"{k}{str(v).replace('.', '-')}" for k, v in sorted(clamp_request(**request).items()))])


def encode_cached(splats: DataFrame, folder: str, name: str, fps: float = 30.0, **request) -> str:
    """Encodes for a request (pos_mm, color_levels, rot_steps, scale_pct, gop, zstd_level), unless its file is already there; returns the path."""
    import os

    from trackloom.config import clamp_request

    path = os.path.join(folder, cache_key(name, **request))
    if not os.path.exists(path):
        r = {"pos_mm": 2.0, "color_levels": 4, "rot_steps": 0, "scale_pct": 2.0, "gop": 30, "zstd_level": 3} | clamp_request(**request)
        bounds = Bounds(r["pos_mm"] / 1000, r["scale_pct"] / 100, r["color_levels"], r["color_levels"], r["rot_steps"])
        encode(splats, path + ".part", bounds, r["gop"], r["zstd_level"], fps)
        os.replace(path + ".part", path)
    return path


def report_json(report: dict) -> str:
    return json.dumps(report, indent=1)


def info(path: str) -> dict:
    """The header, with sizes in bytes."""
    h = container.read_header(path)
    return h | {"header_bytes": h["static_section"]["offset"], "file_bytes": h["gops"][-1]["offset"] + h["gops"][-1]["len"] if h["gops"] else h["static_section"]["offset"] + h["static_section"]["len"]}


def static_meta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, st_attr, base_channel) out of the static section."""
    h, s = container.read_header(path), container.read_static(path)
    n = h["n"]
    data = {"ord": np.arange(n)} | {f"st_{a}": np.unpackbits(s[f"mask_{a}"].astype(np.uint8))[:n].astype(bool) for a in ATTRS}
    for a in ATTRS:
        v = s[f"base_{a}"].reshape(n, CHANNELS[a])
        v = np.cumsum(unzz(v), 0) if a in FLOATS else v - 128 if a == "rot" else v
        data |= {f"base_{c}": v[:, k] for k, c in enumerate(PARTS[a])}
    return spark.createDataFrame(pd.DataFrame(data))


def decoded_bins(spark: SparkSession, path: str, attr: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """(ord, frame, bin_channel) of the moving entities; only the groups of the wanted frames (first, last) are read."""
    h = container.read_header(path)
    c, dyn, gop = CHANNELS[attr], h["dyn"][attr], h["gop"]
    container.register(spark)
    rows = spark.read.format("trackpack").load(path).where(F.col("attr") == ATTRS[attr])
    if frames:
        rows = rows.where((F.col("gop") >= frames[0] // gop) & (F.col("gop") <= frames[1] // gop))
    per = max(dyn * c, 1)
    frame = F.col("gop") * gop + F.when(F.col("kind") == container.KEY, 0).otherwise(1 + F.floor(F.col("pos") / per))
    place = F.floor((F.col("pos") % per) / c)
    w = Window.partitionBy("gop", "j", "ch").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    v = rows.select("gop", frame.cast("bigint").alias("frame"), place.cast("bigint").alias("j"), (F.col("pos") % c).alias("ch"), unzigzag(F.col("sym")).alias("d")).withColumn("bin", F.sum("d").over(w))
    if frames:
        v = v.where(F.col("frame").between(*frames))
    wide = v.groupBy("frame", "j").agg(*(F.max(F.when(F.col("ch") == k, F.col("bin"))).alias(f"bin_{p}") for k, p in enumerate(PARTS[attr])))
    dynamic = np.flatnonzero(np.unpackbits(container.read_static(path)[f"mask_{attr}"].astype(np.uint8))[: h["n"]] == 0)
    index = spark.createDataFrame(pd.DataFrame({"j": np.arange(len(dynamic)), "ord": dynamic}), "j long, ord long")
    return wide.join(index, "j").drop("j")


def header_bounds(path: str) -> Bounds:
    return Bounds(**container.read_header(path)["bounds"])


def decode(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, clamped: bool = True) -> DataFrame:
    """(frame, ord, channels): reconstructed values in file order; scales as logarithms, quaternions centred. Clamped as a viewer shows them, or as they are."""
    h, bounds = container.read_header(path), header_bounds(path)
    first, last = frames or (0, h["t"] - 1)
    meta = static_meta(spark, path)
    out = meta.crossJoin(F.broadcast(spark.range(first, last + 1).withColumnRenamed("id", "frame")))  # a row a frame
    for a in ATTRS:
        step, pitch, _ = bounds.of(a)
        if h["dyn"][a]:
            out = out.join(decoded_bins(spark, path, a, (first, last)), ["ord", "frame"], "left")
        for c in PARTS[a]:
            fixed = F.col(f"base_{c}") * pitch
            v = F.when(F.col(f"st_{a}"), fixed).otherwise(F.col(f"bin_{c}") * step) if h["dyn"][a] else fixed
            if clamped and a not in FLOATS:
                low, high = (-128, 127) if a == "rot" else (0, 255)
                v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
            out = out.withColumn(c, v)
    return out.select("frame", "ord", *(c for a in ATTRS for c in PARTS[a]))


def to_splats(decoded: DataFrame) -> DataFrame:
    """Decoded values as records of the `splat` source, in file order."""
    return decoded.select(
        F.col("frame").cast("int").alias("frame"), F.col("ord").cast("int").alias("splat_id"), *(F.col(c).cast("float").alias(c) for c in "xyz"),
        *(F.exp(f"l{k}").cast("float").alias(s) for k, s in enumerate(("sx", "sy", "sz"))), *(F.col(c).cast("smallint").alias(c) for c in "rgba"), *((F.col(f"q{k}") + 128).cast("smallint").alias(f"q{k}") for k in range(4)),
    )


def verify(spark: SparkSession, path: str, splats: DataFrame, sig: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(attr, rows, max_err, bound, ok): all frames against the signal; the order of points is derived anew from the header's bounds."""
    h, bounds = container.read_header(path), header_bounds(path)
    sig = sig if sig is not None else signal(splats, h["denoised"])
    meta = meta if meta is not None else front_end(sig, bounds)[0]
    ref = sig.join(meta.select("entity", "ord"), "entity")
    back = decode(spark, path, clamped=False)
    both = ref.alias("r").join(back.alias("d"), ["ord", "frame"])
    worst = [F.max(F.greatest(*(F.abs(F.col(f"r.{c}") - F.col(f"d.{c}")).cast("double") for c in PARTS[a]), F.lit(0.0))).alias(a) for a in ATTRS]
    row = both.agg(F.count("*").alias("rows"), *worst)
    each = []
    for a in ATTRS:
        bound = float(math.log(1 + bounds.scale_rel) if a == "scale" else bounds.of(a)[2])
        each.append(F.struct(F.lit(a).alias("attr"), F.col(a).alias("max_err"), F.lit(bound).alias("bound"), (F.col(a) <= bound + (VERIFY_SLACK if a in FLOATS else 0)).alias("ok")))
    return row.select("rows", F.explode(F.array(*each)).alias("e")).select("e.attr", "rows", "e.max_err", "e.bound", (F.col("e.ok") & (F.col("rows") == h["n"] * h["t"])).alias("ok"))
