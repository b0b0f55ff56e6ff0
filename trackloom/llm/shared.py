"""What several operators share: the cluster's shared folder, batches of bounded size, words and their hashes.

Words are the runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import ship

U64 = np.uint64
#: Text bytes that one vectorised step handles; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a temporary one is set, on a local master only, as no other executor could read it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_trackloom_dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc._trackloom_dir = found
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trackloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trackloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that `cut` made and that nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t._trackloom_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder belongs to the cluster
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB, as texts can be long; and the package at the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a word that are hashed side by side with those of other words; longer words are hashed one by one.
LONG_WORD = 128


def hash_spans(buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]: eight bytes a step, each step a bijection of the hash so far. buf needs eight bytes behind the last span."""
    # every eight bytes of the buffer as a number, without a copy
    eights = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))
    size = end - start
    h = mix(size.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    short = np.flatnonzero(size <= LONG_WORD)
    at, left = start[short], size[short]
    while len(short):
        ends = left < 8
        mask = np.where(ends, (U64(1) << (U64(8) * np.minimum(left, 7).astype(np.uint64))) - U64(1), ~U64(0))
        h[short] = mix((h[short] ^ (eights[at] & mask)) * U64(0xD6E8FEB86659FD93))
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]])
    return h


def fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hash of a sequence h with x behind it; not linear, so no arrangement of words makes sequences meet."""
    h = (h ^ x) * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(29))


def steps(column: pa.Array, most: int = STEP_BYTES):
    """(first, last) row ranges of a string column with about `most` bytes each, one row at least."""
    arr = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(arr)
    at, n = 0, len(arr)
    while at < n:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield at, end
        at = end


class Words:
    """Words of a slice of texts: `hash` per word, `doc` (row in the slice) per word, `first`/`last` word of each row. A space must be a separator."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, spans: bool = False, separators: np.ndarray = _SPACE):
        buf = b" " + b" ".join(t or b"" for t in texts) + b" " * 9
        raw = np.frombuffer(buf, np.uint8)
        space = separators[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        offset = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
        bounds = np.searchsorted(start, offset)
        self.first, self.last = bounds[:-1], bounds[1:]
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        self.hash = hash_spans(buf.translate(_LOWER) if lower else buf, start, end)
        if spans:
            self.raw, self.start, self.end = buf, start, end

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, ok) for each word: the k words from it on; ok where they lie within one row."""
        n = len(self.hash)
        ok = np.zeros(n, bool)
        if n < k:
            return np.zeros(n, np.uint64), ok
        h = np.full(n - k + 1, U64(k))
        for j in range(k):
            h = fold(h, self.hash[j : n - k + 1 + j])
        ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return np.concatenate((mix(h + U64(seed)), np.zeros(k - 1, np.uint64))), ok


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def spread_join(rows: DataFrame, few: DataFrame, by: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined to `few`, which has a row a key. A key of any number of rows is spread over tasks by a hash of other columns; what `few` says
    of it goes to each of them once."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(partitions(rows.sparkSession))).cast("int"))
    return salted.join(salted.select(*by, "_salt").distinct().join(few, by), [*by, "_salt"], how).drop("_salt")


def with_facts(rows: DataFrame, by: list[str], spread: list[str], **facts: tuple[str, str]) -> DataFrame:
    """rows with facts of their groups (name = (min, max or sum, column)), groups of any size spread over tasks."""
    return spread_join(rows, rows.groupBy(*by).agg(*(getattr(F, f)(c).alias(name) for name, (f, c) in facts.items())), by, spread)
