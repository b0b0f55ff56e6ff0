"""Exact top-k search by term-at-a-time accumulation.

Vectors are rows of integer weights; a term is a dimension. Candidates are packed into blocks of postings (per term the places of
the vectors with a weight there, and the weights); queries into blocks of sparse rows. A task holds one candidate block and runs query
blocks past it: each term of a query scatters its weighted posting into a dense array of scores (a posting that covers most of its
block is kept dense and added whole). A partition selection takes the block's k best, ties to the smaller id, and the
blocks' lists are merged by rank. Every candidate is scored against every query.

Vectors that are null or hold a null or non-finite component take no part, neither do rows with a null id. Missing trailing components count as
zero. Scores beyond 64 bits are held at its ends. A query's own row is no candidate: rows of the query's id are left out. Repeated rows of
another id each take a rank. Columns other than id and vector play no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.shared import documents, partitions

#: Candidates and queries of a block: what a task holds at once.
CANDIDATES, QUERIES_PER_BLOCK = 4096, 512
#: Pairs of blocks in a tile, where the blocks give so many.
TILE = 256
_ENDS = (-(1 << 63), (1 << 63) - 1)


def valid(vector: str) -> Column:
    """Whether a vector is complete: not null, no null or non-finite component."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(vectors: pa.ListArray) -> list[np.ndarray]:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _weights(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in the narrowest integers; Python integers where 64 bits would not hold the products."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * rows)
    most = np.abs(scaled).max(initial=0)
    if most >= 2.0**28:
        return np.array([[int(y) if np.isfinite(y) else int(x) * int(scale) for x, y in zip(*z)] for z in zip(rows, scaled)], object)
    return scaled.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32)


class Postings:
    """The postings of a block of candidates, sorted by id so that a place also breaks ties."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, weights = ids[order], weights[order]
        if weights.dtype != object:
            weights = weights.astype(np.int32 if weights.dtype != np.int32 else np.int64)
        self.type = weights.dtype
        self.terms = []
        for column in weights.T:
            places = np.flatnonzero(column)
            if len(places):
                dense = 2 * len(places) > len(column)
                self.terms.append((None, np.ascontiguousarray(column)) if dense else (places, column[places]))
            else:
                self.terms.append(None)
        self.most = np.abs(weights).max(initial=0)

    def scores(self, query: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(query[: len(self.terms)])
        most = int(self.most) * int(np.abs(query).max(initial=0)) * max(1, len(used))
        kind = object if self.type == object or query.dtype == object else np.int32 if most < 1 << 31 and self.type == np.int32 else np.int64
        acc = np.zeros(len(self.ids), kind)
        for t in used.tolist():
            if self.terms[t] is not None:
                places, weights = self.terms[t]
                if places is None:
                    acc += weights * (kind(query[t]) if kind is not object else query[t])
                else:
                    acc[places] += weights * (kind(query[t]) if kind is not object else query[t])
        return acc

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but for the query's own rows."""
        acc = self.scores(query)
        if acc.dtype == object:
            acc = np.array([min(max(int(x), _ENDS[0]), _ENDS[1]) for x in acc], np.int64)
        own = np.searchsorted(self.ids, [query_id, query_id + 1])
        free = np.concatenate((np.arange(own[0]), np.arange(own[1], len(self.ids)))) if own[1] > own[0] else None
        s = acc if free is None else acc[free]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            over = np.flatnonzero(s > edge)
            at = np.concatenate((over, np.flatnonzero(s == edge)[: k - len(over)]))
        else:
            at = np.arange(len(s))
        return self.ids[at if free is None else free[at]], s[at].astype(np.int64)


def _pairs(k: int, scale: float):
    def run(batches):
        held, postings = None, None
        for b in batches:
            for r in range(b.num_rows):
                block = b.column(0)[r].as_py()
                if block != held:
                    postings = Postings(np.frombuffer(b.column(1)[r].as_py(), np.int64), _unpack(b.column(2)[r].as_py(), scale))
                    held = block
                queries = np.frombuffer(b.column(3)[r].as_py(), np.int64)
                rows = _unpack(b.column(4)[r].as_py(), scale)
                q, v, s = [], [], []
                for i, row in zip(queries.tolist(), rows):
                    ids, scores = postings.best(i, row, k)
                    q.append(np.full(len(ids), i))
                    v.append(ids)
                    s.append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, s)], ["query_id", "vec_id", "score"])

    return run


def _unpack(data: bytes, scale: float) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), data[8:10].decode()
    rows = np.frombuffer(data, kind, -1, 10).reshape(n, -1)
    return _weights(rows, scale) if kind == "f8" else rows


def _pack(scale: float):
    def run(table):
        rows = _padded(_matrix(table.column("v").combine_chunks()))
        weights = _weights(rows, scale)
        kept = rows if weights.dtype == object else weights
        data = len(rows).to_bytes(8, "little") + kept.dtype.str[1:].encode() + kept.tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()]), "data": pa.array([data])})

    return run


def _blocks(rows: DataFrame, size: int, n: int, scale: float) -> DataFrame:
    """(block, ids, data): rows dealt by a hash of their id into blocks of about `size` rows, one row a block."""
    count = max(1, -(-n // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(count)))
    return dealt.groupBy("block").applyInArrow(_pack(scale), "block long, ids binary, data binary")


def search(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where is_query holds."""
    every = df.where(is_query.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    every = every.where("id is not null").where(valid("v")).withColumn("v", F.col("v").cast("array<double>"))
    n, queries = every.agg(F.count("*"), F.count_if("q")).first()
    blocks, many = max(1, -(-queries // QUERIES_PER_BLOCK)), max(1, -(-n // CANDIDATES))
    down, across = _grid(many, blocks, partitions(df.sparkSession))
    candidates = _blocks(every.select("id", "v"), CANDIDATES, n, scale).select(F.col("block").alias("c"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    asked = _blocks(every.where("q").select("id", "v"), QUERIES_PER_BLOCK, queries, scale).select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # the stated query blocks meet every candidate block, in a grid of tiles: a block is sent once to each tile of its row or column, not once a pair
    a = candidates.withColumn("row", F.col("c") % down).withColumn("column", F.explode(_numbers(across)))
    b = asked.withColumn("column", F.col("q") % across).withColumn("row", F.explode(_numbers(down)))
    met = a.join(b.hint("shuffle_hash"), ["row", "column"]).select("c", "c_ids", "c_data", "q_ids", "q_data")
    found = met.mapInArrow(_pairs(k, scale), "query_id long, vec_id long, score long")
    return ranked(found, k)


def _grid(candidates: int, queries: int, tasks: int) -> tuple[int, int]:
    """(rows, columns) of tiles of blocks: a tile a task at least (if there are so many pairs), TILE pairs a tile, and what is sent, candidates * columns + queries * rows, small."""
    tiles = max(tasks, candidates * queries // TILE)
    across = min(queries, max(1, round((tiles * queries / candidates) ** 0.5)))
    return min(candidates, -(-tiles // across)), across


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps k rows a query in each task before it shuffles."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_exact_top_k": op3}
SQL = {
    "op3_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
 FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
