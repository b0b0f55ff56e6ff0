"""Packing, containers, text forms and streams."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from trackloom.config import Bounds
from trackloom.operators import codec, symbols
from trackloom.operators.tracks import table
from trackloom.plans.codec_queries import _index, long
from trackloom.plans.registry import EV, GOP, SYMBOLS, query
from trackloom.sources import container
from trackloom.streaming import tracks as stream

_W = "(CASE WHEN max(sym) < 256 THEN 1 WHEN max(sym) < 65536 THEN 2 ELSE 4 END)"


@query(f"WITH {SYMBOLS} SELECT gop, kind, count(*) AS elems, (count(*) * {_W})::BIGINT AS raw_bytes, true AS same FROM sy GROUP BY gop, kind")
def pack_zstd_roundtrip(spark, sf_dir):
    """Each stream is shuffled into byte planes, compressed, read again and compared."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["sym"].to_numpy(np.int64)
        s = container.pack_stream(0, int(pdf["kind"].iloc[0]), v, 3)
        back, _ = container.read_stream(container.stream_head(s) + s["payload"], 0)
        return pd.DataFrame([{"gop": pdf["gop"].iloc[0], "kind": pdf["kind"].iloc[0], "elems": s["elems"], "raw_bytes": s["raw_bytes"], "same": bool((back["symbols"] == v).all())}])

    return long(spark, sf_dir).groupBy("gop", "kind").applyInPandas(run, "gop long, kind long, elems long, raw_bytes long, same boolean")


@query()
def gzip_baseline(spark, sf_dir):
    """Generic lossless sizes: gzip by file and as one stream a partition, zstd with a long window as one stream a partition."""

    def run(batches):
        alone = raw = 0
        one, two = zlib.compressobj(9, zlib.DEFLATED, 31), zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, window_log=23, enable_ldm=True)).compressobj()
        joined = long_window = 0
        for pdf in batches:
            for t in pdf["text"]:
                data = (t or "").encode()
                raw += len(data)
                alone += len(gzip.compress(data, 9))
                joined += len(one.compress(data))
                long_window += len(two.compress(data))
        yield pd.DataFrame([{"raw": raw, "alone": alone, "joined": joined + len(one.flush()), "zstd": long_window + len(two.flush())}])

    sizes = table(spark, sf_dir, "conversations").select("text").mapInPandas(run, "raw long, alone long, joined long, zstd long")
    return sizes.agg(*(F.sum(c).alias(c) for c in ("raw", "alone", "joined", "zstd")))


def splats(spark, sf_dir, frames: int = 6):
    """A sequence of points made from embeddings: odd ones stand still, even ones move."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    e = e.join(F.broadcast(spark.range(frames).select(F.col("id").cast("int").alias("frame"))))
    at = lambda k: F.col("embedding")[k].cast("double")
    move = F.when(F.col("vec_id") % 2 == 0, F.sin(F.col("frame") * 0.1 + F.col("vec_id"))).otherwise(0.0)
    byte = lambda c: F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(255.0)).cast("smallint")
    return e.select(
        "frame", F.col("vec_id").cast("int").alias("splat_id"), *((at(k) + move * 0.05 * (k + 1)).cast("float").alias(c) for k, c in enumerate("xyz")), *(F.exp(at(7 + k) - 3).cast("float").alias(c) for k, c in enumerate(("sx", "sy", "sz"))),
        *(byte(at(10 + k) * 200 + 128 + move * 9).alias(c) for k, c in enumerate("rgb")), F.lit(200).cast("smallint").alias("a"), *(byte(at(3 + k) * 128 + 128 + move * 5).alias(f"q{k}") for k in range(4)),
    )


def _encoded(spark, sf_dir):
    import os

    path = stream.work_dir(spark).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    report = codec.encode(splats(spark, sf_dir), f"{path}/points", Bounds(0.005, 0.02, 4, 4, 1), gop=4, check=False)
    return f"{path}/points", report


@query("SELECT attr, (SELECT count(*) * 6 FROM embeddings WHERE embedding IS NOT NULL) AS rows, true AS ok FROM (SELECT unnest(['pos', 'rot', 'rgb', 'alpha', 'scale']) AS attr)")
def container_verify(spark, sf_dir):
    """Encode, write the container, read it again and hold every frame against its bounds."""
    path, _ = _encoded(spark, sf_dir)
    return codec.verify(spark, path, splats(spark, sf_dir)).select("attr", "rows", "ok")


@query()
def container_decode(spark, sf_dir):
    """One frame out of the container; only its frame group is read."""
    path, _ = _encoded(spark, sf_dir)
    return codec.to_splats(codec.decode(spark, path, (4, 4)))


@query()
def container_keys(spark, sf_dir):
    """Symbols of the keys of one group: a pruned partition, and of it only the prefix."""
    path, _ = _encoded(spark, sf_dir)
    container.register(spark)
    return spark.read.format("trackpack").load(path).where("gop = 1 and kind = 0")


@query()
def container_report(spark, sf_dir):
    """Sizes by stream."""
    _, report = _encoded(spark, sf_dir)
    return spark.createDataFrame(pd.DataFrame(report["streams"]))


@query(f"WITH {EV}, f AS (SELECT frame, count(*) AS len FROM ev GROUP BY frame), g AS (SELECT (frame // {GOP})::BIGINT AS gop, min(frame) AS f0, max(frame) AS f1 FROM f GROUP BY 1) SELECT gop, '{{\"f0\":' || f0 || ',\"f1\":' || f1 || '}}' AS entry, 'frame_' || lpad(f0::VARCHAR, 4, '0') || '.splat' AS file, f1 AS back FROM g")
def json_header(spark, sf_dir):
    """Index entries as JSON and back, with the names of their first files."""
    g = _index(spark, sf_dir)
    j = g.select("gop", F.to_json(F.struct("f0", "f1")).alias("entry"), F.format_string("frame_%04d.splat", "f0").alias("file"))
    return j.withColumn("back", F.from_json("entry", "f0 bigint, f1 bigint")["f1"])


@query("SELECT event_type, 'dyn.' || event_type || '.key' AS name, event_type AS attr, starts_with(event_type, 'p') AS p, 'gop30_' || replace(event_type, 'c', '-') AS cache_key, count(*) AS n FROM events GROUP BY event_type")
def stream_names(spark, sf_dir):
    """Names of streams put together and taken apart; cache keys from parameters."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    named = e.withColumn("name", F.concat_ws(".", F.lit("dyn"), "event_type", F.lit("key")))
    return named.select("event_type", "name", F.split("name", r"\.")[1].alias("attr"), F.startswith("event_type", F.lit("p")).alias("p"), F.concat_ws("_", F.lit("gop30"), F.replace("event_type", F.lit("c"), F.lit("-"))).alias("cache_key"), "n")


@query(f"WITH {EV} SELECT frame, 'bytes=' || frame * 32 || '-' || (frame * 32 + 31) AS range, frame * 32 AS first, frame * 32 + 31 AS last, round(frame / 20.0, 6) AS t, least((SELECT max(frame) FROM ev), floor(frame / 20.0 * 20))::BIGINT AS at FROM ev GROUP BY frame")
def byte_ranges(spark, sf_dir):
    """Range headers of frames, parsed; frames to seconds and back."""
    from trackloom.operators.tracks import ev_track

    f = ev_track(spark, sf_dir).select("frame").distinct()
    f = f.crossJoin(F.broadcast(f.agg(F.max("frame").alias("end"))))
    r = f.withColumn("range", F.format_string("bytes=%d-%d", F.col("frame") * 32, F.col("frame") * 32 + 31))
    part = lambda k: F.regexp_extract("range", r"bytes=(\d*)-(\d*)", k).cast("bigint")
    return r.select("frame", "range", part(1).alias("first"), part(2).alias("last"), F.round(F.col("frame") / 20.0, 6).alias("t"), F.least("end", F.floor(F.col("frame") / 20.0 * 20)).cast("bigint").alias("at"))


@query("SELECT epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return stream.settle(stream.tumbling(stream.stream(spark, sf_dir), "1 day"), "complete")


@query("WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events)) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 hour <= (SELECT max(ts) - INTERVAL 1 day FROM events)")
def stream_session(spark, sf_dir):
    """Sessions that the watermark has closed."""
    return stream.settle(stream.sessions(stream.stream(spark, sf_dir), "6 hours"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return stream.settle(stream.distinct_within(stream.stream(spark, sf_dir), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query(f"WITH {SYMBOLS} SELECT d.entity, d.frame, d.gop, d.kind, held.b AS bin, d.n AS delta FROM d JOIN held USING (entity, frame)")
def stream_gop_hold(spark, sf_dir):
    """Keys and deltas of each track with state, as in the batch."""
    return stream.settle(stream.rolling_bins(stream.stream(spark, sf_dir), 4.0, GOP))


@query(f"WITH {SYMBOLS} SELECT entity, frame, b AS bin, true AS exact FROM held")
def stream_rollforward(spark, sf_dir):
    """Symbols stored as files and decoded as a stream with the current bin as state."""
    from trackloom.plans.codec_queries import syms

    out = stream.work_dir(spark)
    s = syms(spark, sf_dir).select("entity", "frame", F.col("sym_b").alias("sym"))
    s.coalesce(1).write.parquet(f"{out}/symbols")
    read = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/symbols")
    return stream.settle(stream.rolling_decode(read, GOP))


@query("SELECT epoch(s)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 hour, ts), time_bucket(INTERVAL 12 hour, ts) - INTERVAL 12 hour]) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return stream.settle(stream.tumbling(stream.stream(spark, sf_dir), "1 day", slide="12 hours"), "complete")


@query(f"WITH {SYMBOLS} SELECT entity, frame, b FROM held")
def stream_then_decode(spark, sf_dir):
    """What the stream wrote, decoded by prefix sums."""
    s = stream.settle(stream.rolling_bins(stream.stream(spark, sf_dir), 4.0, GOP))
    from trackloom.functions.scalar import zigzag

    return symbols.prefix_decode(s.select("entity", "frame", "gop", zigzag(F.col("delta")).alias("sym_b")), ["b"])
