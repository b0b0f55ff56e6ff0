"""Structured Streaming forms: windows, sessions, deduplication, and tracks with state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trackloom.session import ship


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares; where that is unset a temporary one, on a local master only, as no other executor could read it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/trackloom-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, table: str = "events", files: int = 1) -> DataFrame:
    ship(spark)
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which may match a file or a folder


def settle(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows as a batch; complete results go through the sink of the last batch."""
    spark, out = df.sparkSession, work_dir(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{out}/rows")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total): tumbling windows, or sliding ones."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, start, n): closed sessions."""
    g = timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def rolling_decode(symbols: DataFrame, gop: int) -> DataFrame:
    """(entity, frame, bin, exact): bins rolled forward from (entity, frame, sym) as they arrive; the state is the current frame and bin.

    The next frame of a group continues from the state; a group's first frame starts anew. A frame that arrives out of turn cannot be exact: the last known bin
    is given with exact = false, and the track waits for its next key.
    """
    from trackloom.functions.arrow import unzz

    def run(key, batches, state):
        last, now = state.get if state.exists else (-2, 0)
        rows = []
        for frame, d in pd.concat(list(batches)).sort_values("frame")[["frame", "sym"]].itertuples(index=False):
            delta = int(unzz(np.array([d]))[0])
            exact = frame % gop == 0 or frame == last + 1
            now = delta if frame % gop == 0 else now + delta if exact else now
            last = frame if exact else -2
            rows.append((key[0], frame, now, exact))
        state.update((int(last), int(now)))
        yield pd.DataFrame(rows, columns=["entity", "frame", "bin", "exact"])

    return symbols.select("entity", "frame", "sym").groupBy("entity").applyInPandasWithState(run, "entity long, frame long, bin long, exact boolean", "last long, now long", "append", GroupStateTimeout.NoTimeout)


def rolling_bins(events: DataFrame, step: float, gop: int) -> DataFrame:
    """(entity, frame, gop, kind, bin, delta) of each user's values, with the last frame and bin as state: keys and deltas as the rows arrive.

    Rows of a micro-batch are put in time order; rows that come in a later batch continue the track.
    """
    from trackloom.operators.hold import quantized

    def run(key, batches, state):
        frame, last = state.get if state.exists else (0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        bins = quantized(pdf["value"].to_numpy(float), step, False).astype("int64")
        frames = range(frame, frame + len(bins))
        before = [last, *bins[:-1].tolist()]
        rows = [(key[0], f, f // gop, int(f % gop != 0), b, b - p if f % gop else b) for f, b, p in zip(frames, bins.tolist(), before)]
        state.update((frame + len(bins), int(bins[-1])))
        yield pd.DataFrame(rows, columns=["entity", "frame", "gop", "kind", "bin", "delta"])

    out = "entity long, frame long, gop long, kind long, bin long, delta long"
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(run, out, "frame long, bin long", "append", GroupStateTimeout.NoTimeout)
