import random
import zlib
from collections import Counter, defaultdict

from trackloom.llm import sharding


def check(rows, texts, shards, most=0.03, long_texts=False):
    """rows: of the result; texts: text by id."""
    assert sorted(r.id for r in rows) == sorted(texts)
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = (texts[r.id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        assert 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[texts[r.id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(sizes.values()) / shards
    # no shard is further from its share than a part of it, and the longest text where texts are long
    spread = max(abs(sizes[s] - share) for s in range(shards))
    assert spread <= most * share + (max(r.size for r in rows) if long_texts else 0), spread
    weight = Counter()
    for r in rows:
        weight[texts[r.id]] += r.size
    assert all(len(s) == 1 for t, s in where.items() if weight[t] <= share)


def run(spark, texts, shards):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sharding.shard(df, shards).collect()


def test_near_equal_with_a_hot_text(spark):
    rng = random.Random(2)
    texts = {i: "x" * int(rng.paretovariate(1.3) * 100) + str(i) for i in range(8000)}
    texts |= {i: "the same text " * 20 for i in range(8000, 12000)}  # far more than a shard
    texts |= {i: "another " * 9 for i in range(12000, 12060)}
    check(run(spark, texts, 10), texts, 10)


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in sharding.documents(spark, sf).collect()}
    rows = sharding.op6(spark, sf).withColumnRenamed("doc_id", "id").collect()
    check(rows, docs, 40, long_texts=True)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "é", 3)], "doc_id long, text string, shard int")
    rows = sharding.shard(df, 3).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == [(16, 0), (16, 0), (16, 0), (18, zlib.crc32("é".encode()))]
    assert len({(r.shard, r.slot) for r in rows}) == 4
    assert sharding.shard(df.limit(0), 3).count() == 0


def test_many_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "the same text", k, k) for k in range(3000)] + [(k, f"t{k}", k, k) for k in range(1000)], "doc_id long, text string, size int, h int")
    rows = sharding.shard(df, 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 4000 and len({(r.shard, r.slot) for r in rows}) == 4000
    assert max(sizes.values()) <= 1.1 * min(sizes.values()) and len(sizes) == 8
