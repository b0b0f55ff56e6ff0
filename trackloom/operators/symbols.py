"""From held bins to symbols and back: frame groups, keys and deltas, byte planes, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import check_gop
from trackloom.functions.ordering import neighbours, ordinals
from trackloom.functions.scalar import symbol_width, unzigzag, zigzag


def gop_of(frame: Column, gop: int) -> Column:
    return F.floor(frame / check_gop(gop)).cast("bigint")


def gop_symbols(held: DataFrame, bins: list[str], gop: int) -> DataFrame:
    """(entity, frame, gop, kind, sym_b): zigzagged bins of a group's first frame (kind 0) and changes within it (kind 1)."""
    w = Window.partitionBy("entity", "gop").orderBy("frame")
    g = held.withColumn("gop", gop_of(F.col("frame"), gop))
    first = F.row_number().over(w) == 1
    g = g.select("*", first.alias("first"), *(F.lag(b).over(w).alias(f"p_{b}") for b in bins))
    return g.select("entity", "frame", "gop", F.when(F.col("first"), 0).otherwise(1).cast("bigint").alias("kind"), *(zigzag(F.when(F.col("first"), F.col(b)).otherwise(F.col(b) - F.col(f"p_{b}"))).cast("bigint").alias(f"sym_{b}") for b in bins))


def prefix_decode(symbols: DataFrame, bins: list[str]) -> DataFrame:
    """(entity, frame, b): the inverse; every group decodes by itself."""
    w = Window.partitionBy("entity", "gop").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return symbols.select("entity", "frame", *(F.sum(unzigzag(F.col(f"sym_{b}"))).over(w).cast("bigint").alias(b) for b in bins))


def long_symbols(symbols: DataFrame, bins: list[str]) -> DataFrame:
    """(gop, kind, attr, sym): one row a symbol."""
    return symbols.select("gop", "kind", F.explode(F.array(*(F.struct(F.lit(b).alias("attr"), F.col(f"sym_{b}").alias("sym")) for b in bins))).alias("s")).select("gop", "kind", "s.attr", "s.sym")


STREAM = ("gop", "attr", "kind")


def widths(symbols: DataFrame) -> DataFrame:
    """(stream, elems, width, raw_bytes)."""
    s = symbols.groupBy(*STREAM).agg(F.count("*").alias("elems"), F.max("sym").alias("most"))
    return s.select(*STREAM, "elems", symbol_width(F.col("most")).cast("bigint").alias("width"), (F.col("elems") * symbol_width(F.col("most"))).cast("bigint").alias("raw_bytes"))


def byte_planes(symbols: DataFrame) -> DataFrame:
    """(stream, plane, byte, n): how often a byte stands in a plane of a stream; symbols are counted before they are split."""
    counted = symbols.groupBy(*STREAM, "sym").agg(F.count("*").alias("n"))
    w = counted.groupBy(*STREAM).agg(symbol_width(F.max("sym")).alias("width"))
    split = counted.join(w, list(STREAM)).select(*STREAM, "n", "sym", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("plane"))
    return split.groupBy(*STREAM, F.col("plane").cast("bigint").alias("plane"), F.floor(F.col("sym") / F.pow(F.lit(256.0), F.col("plane"))).cast("bigint").bitwiseAND(F.lit(255).cast("bigint")).alias("byte")).agg(F.sum("n").alias("n"))


def entropy_bytes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, entropy_bytes) from a histogram with a column n: the order-0 size of its values."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    return total.select(*keys, "n", F.round((F.col("n") * F.log2("n") - F.col("nlog")) / 8, 6).alias("entropy_bytes"))


def plane_entropy(symbols: DataFrame) -> DataFrame:
    """All planes of a stream are pooled into one histogram."""
    return entropy_bytes(byte_planes(symbols).groupBy(*STREAM, "byte").agg(F.sum("n").alias("n")), list(STREAM))


def symbol_entropy(symbols: DataFrame) -> DataFrame:
    return entropy_bytes(symbols.groupBy(*STREAM, "sym").agg(F.count("*").alias("n")), list(STREAM))


def sparse_events(held: DataFrame, b: str) -> DataFrame:
    """(entity, frame, gap, delta): only the changes, with the distance to the entity that changed before in the same frame."""
    w = Window.partitionBy("entity").orderBy("frame")
    c = held.select("entity", "frame", (F.col(b) - F.lag(b).over(w)).alias("delta")).where("delta <> 0")
    # ranges of (frame, entity), as a frame can hold most entities
    c = neighbours(ordinals(c, "frame", "entity"), "ord", ["frame", "entity"])
    before = F.when(F.col("prev_frame") == F.col("frame"), F.col("prev_entity")).otherwise(0)
    return c.select("entity", "frame", "delta", (F.col("entity") - before).alias("gap"))


def gop_index(frames: DataFrame, gop: int, fps: float) -> DataFrame:
    """(gop, f0, f1, t0, t1, len, offset) for (frame, len): spans of groups; t1 is the start of the last frame."""
    g = frames.groupBy(gop_of(F.col("frame"), gop).alias("gop")).agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.sum("len").alias("len"))
    before = F.coalesce(F.sum("len").over(Window.orderBy("gop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a group
    return g.select("gop", "f0", "f1", F.round(F.col("f0") / fps, 6).alias("t0"), F.round(F.col("f1") / fps, 6).alias("t1"), "len", before.cast("bigint").alias("offset"))
