import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def run(df, k=20):
    return sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [0.0 if rng.random() < 0.6 else rng.randint(-3, 3) / 16 for _ in range(9)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 9) for i in range(70)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(df) == brute(rows, 20)


def test_few_rows_odd_vectors_and_other_columns(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (3, [0.5, -1.5, 7.0]), (4, None), (40, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1e30, 1.0]), (8, [1e30, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = run(df)
    want = brute([(i, v) for i, v in rows], 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == min(max(w[3], -(2**63)), 2**63 - 1) for g, w in zip(got, want))
    assert run(df.limit(0)) == []


def test_whole_table(spark, sf):
    e = topk.documents(spark, sf, "embeddings").collect()
    v = np.floor(64 * np.array([r.embedding for r in e])).astype(np.int64)
    ids = np.array([r.vec_id for r in e])
    got = sorted(map(tuple, topk.op3(spark, sf).collect()))
    want = []
    for i, q in zip(ids, v):
        if i % 20 == 0:
            s = v @ q
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
            want += [(int(i), r, int(ids[k]), int(s[k])) for r, k in enumerate(order, 1)]
    assert got == sorted(want)


def test_tiles_hold_every_pair():
    for candidates, queries, tasks in ((1, 1, 8), (5, 1, 8), (30, 7, 4), (24_414, 9766, 4000)):
        rows, columns = topk._grid(candidates, queries, tasks)
        assert 1 <= rows <= candidates and 1 <= columns <= queries
        assert candidates * columns + queries * rows <= 2 * candidates * queries
    assert 24_414 * columns + 9766 * rows < 0.1 * 2 * 24_414 * 9766


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 5)
    monkeypatch.setattr(topk, "TILE", 3)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (400, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 7 == 0, 9).collect())
    w = np.floor(64 * v).astype(np.int64)
    want = []
    for q in range(0, 400, 7):
        best = sorted((-int(w[q] @ w[c]), c) for c in range(400) if c != q)[:9]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == want
