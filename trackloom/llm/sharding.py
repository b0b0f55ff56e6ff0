"""Sharding by sampled splitters, law `bytes`: shards of near equal size, in DataFrame operations only.

A record's key is the hash of its text, then its id, so equal texts lie side by side. A size-weighted sample of keys gives
quantile splitters for many small ranges; ranges that turn out overfull are subdivided with a denser sample. The exact bytes and rows of each range
are then counted, and the ranges dealt to the shards: a text whose copies fill several ranges, and any large range, is placed as one unit,
largest first; the rest follow in key order so that every shard is filled to its share. Copies of a text stay in one shard unless they
alone exceed a shard's share; only then is such a text divided by id. A record's slot is its rank within its range plus the rows of the shard's earlier
ranges, so no task sorts a whole shard. What reaches the driver is the sample and a line for each range, both bounded by the number of shards.

Null texts have size 16 and the checksum of an empty text. Rows with a null id come last and can be divided like any others. Repeated rows take slots of their own.
Columns other than id and text play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.ranges import longs, range_of
from trackloom.llm.shared import cut, documents

#: Ranges of a shard, sampled keys of a range, and rounds of subdividing.
RANGES, SAMPLES, ROUNDS = 64, 8, 4
#: A unit above this share of a shard is placed by itself.
LARGE = 1 / 16
_LAST = (1 << 63) - 1


def sample(rows: DataFrame, unit: float, salt: int) -> list:
    """Keys drawn with a chance of size / unit, at most 1; each stands for max(size, unit) bytes."""
    chance = F.least(F.col("size") / F.lit(float(max(unit, 1))), F.lit(1.0))
    drawn = F.pmod(F.xxhash64("h", "tie", F.lit(salt)), F.lit(1 << 30)) < chance * (1 << 30)
    return rows.where(drawn).select("h", "tie", F.greatest(F.col("size").cast("double"), F.lit(float(unit))).alias("w")).collect()


def quantiles(drawn: list, target: float) -> list[tuple[int, int]]:
    out, total, edge = [], 0.0, target
    for r in sorted(drawn):
        if total >= edge:
            out.append((r.h, r.tie))
            edge = total + target
        total += r.w
    return out


def _snapped(splitters) -> list[tuple[int, int]]:
    """Splitters at the start of a text's copies; copies that reach over several splitters get ranges of their own."""
    out: set[tuple[int, int]] = set()
    splitters = sorted(set(splitters))
    for k, (h, tie) in enumerate(splitters):
        several = (k and splitters[k - 1][0] == h) or (k + 1 < len(splitters) and splitters[k + 1][0] == h)
        out.add((h, -_LAST - 1))
        if several:
            out.add((h, tie))
            if h < _LAST:
                out.add((h + 1, -_LAST - 1))
    return sorted(out)


def _counted(rows: DataFrame, splitters) -> list:
    got = rows.groupBy(range_of(F.col("h"), F.col("tie"), splitters).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h"), F.max("h").alias("top"))
    return sorted(got.collect())


def plan(rows: DataFrame, shards: int) -> tuple[list, list[int], list[int]]:
    """(splitters, shard of each range, first slot of each range)."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target = total / (shards * RANGES)
    raw = quantiles(sample(rows, target / SAMPLES, 0), target) if n else []
    splitters = _snapped(raw)
    counted = _counted(rows, splitters)
    for k in range(1, ROUNDS):
        full = [r.range for r in counted if r.bytes > 2 * target and r.n > 1]
        if not full:
            break
        inside = rows.where(F.array_contains(longs(full), range_of(F.col("h"), F.col("tie"), splitters).cast("bigint")))
        raw = sorted({*raw, *quantiles(sample(inside, target / (4 * SAMPLES), k), target)})
        splitters = _snapped(raw)
        counted = _counted(rows, splitters)
    by_range = {r.range: r for r in counted}
    share = total / shards
    load, shard_of = [0.0] * shards, {}
    units: dict[int, list] = {}
    for r in counted:  # a range of one text joins the text's other ranges
        units.setdefault(r.h if r.h == r.top else (r.h, r.range), []).append(r)
    whole = []
    for unit in units.values():
        size = sum(r.bytes for r in unit)
        whole += [(size, unit)] if size <= share or len(unit) == 1 else [(r.bytes, [r]) for r in unit]
    for size, unit in sorted((u for u in whole if u[0] > LARGE * share), key=lambda u: (-u[0], u[1][0].range)):
        to = min(range(shards), key=lambda s: (load[s], s))
        load[to] += size
        for r in unit:
            shard_of[r.range] = to
    room = [max(0.0, share - x) for x in load]
    rest = [unit for size, unit in whole if size <= LARGE * share]
    scale = sum(r.bytes for unit in rest for r in unit) / max(sum(room), 1e-9)
    ends = [0.0]
    for x in room:
        ends.append(ends[-1] + x * scale)
    at = 0.0
    for unit in sorted(rest, key=lambda u: u[0].range):
        size = sum(r.bytes for r in unit)
        to = min(bisect.bisect_right(ends, at + size / 2) - 1, shards - 1)
        at += size
        for r in unit:
            shard_of[r.range] = to
    first, rows_in = [], [0] * shards
    for k in range(len(splitters) + 1):
        s = shard_of.get(k, 0)
        first.append(rows_in[s])
        rows_in[s] += by_range[k].n if k in by_range else 0
    return splitters, [shard_of.get(k, 0) for k in range(len(splitters) + 1)], first


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    if shards < 1:
        raise ValueError("one shard at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        # rows without an id are told apart by their number in the written table
        F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.monotonically_increasing_id() % (1 << 62)).alias("tie"),
    )
    rows = cut(rows)
    splitters, shard_of, first = plan(rows, shards)
    placed = rows.withColumn("range", range_of(F.col("h"), F.col("tie"), splitters))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "tie")) - 1
    return placed.select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), F.get(longs(shard_of), F.col("range")).cast("int").alias("shard"),
        (F.get(longs(first), F.col("range")) + rank).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_sharding": op6}
SQL: dict[str, str] = {}
