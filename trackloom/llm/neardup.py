"""MinHash near-dedup with tensored banding.

A document's set holds its distinct shingles of five lower-cased words (A-Z only); with fewer words the whole sequence is the one shingle. Equal
sets (by 128 bits of hashes of all shingles) form a class with a number of its own, and only classes are compared. Two small collections of half keys, each of a few min-hashes,
are computed per class; a table key combines one half key of each collection, so the keys of `halves` squared tables cost 2 * `halves` half keys.
Two classes meet in some table if they share a half key of either collection: for a similarity of 0.75, two min-hashes
a half key and 16 half keys a collection, all but 4 in a million do (1 - (1 - (1 - 0.75**2)**16)**2).

Half keys that no other class shares are dropped first, which loses nothing, so most documents emit no table key at all.
A class of which more than a quarter of the shingles is in no other class that met one cannot be near to any and is set aside, and what a
pair can have in common is bounded by the lesser count of such shared shingles; both are exact.

In each table key's bucket every class is confirmed against the bucket's least class by full sets; links make components. Where a
bucket then still holds several components, the remaining pairs across them are confirmed too, unless their sizes, bitmaps of their sets
(both exact bounds) or their min-hashes rule the similarity out (fewer than 27 of 64 equal has a chance of 1e-8 at 0.75). Pairs inside a
component are never made. Nothing is capped: a half key, a bucket, a class or a centre of any size is spread over tasks by a hash of its members.

Documents without words have no set and link with nothing; so do rows with a null id, whose component is null. Rows of one id count as one
document, whatever their texts; each of these is compared. Other columns are carried along by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.shared import U64, Words, bounded_batches, cut, documents, drop, fold, mix, spread_join, steps, text_bytes

SHINGLE, HALVES, ROWS = 5, 16, 2
SIGNATURE = 2 * HALVES * ROWS
#: Of SIGNATURE min-hashes, so many must agree before two sets are compared; see above.
LEAST_EQUAL = 27
#: Classes of a half key that one task compares with as many others.
GROUP = 2048
#: Longs of the bitmap of a set.
LONGS = 64
_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
_XOR, _MULTIPLY = (_SEEDS >> U64(32)).astype(np.uint32), (_SEEDS & U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h, ok = w.grams(SHINGLE)
    out = []
    for first, last in zip(w.first.tolist(), w.last.tolist()):
        n = last - first
        if n >= SHINGLE:
            out.append(np.unique(h[first : last - SHINGLE + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for k in range(first, last):
                short = fold(short, w.hash[k : k + 1])
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _feature_rows(batches):
    for b in batches:
        texts = text_bytes(b.column(2))
        for i, j in steps(b.column(2)):
            sets = shingle_sets(texts[i:j])
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(n)
            signature = np.zeros((len(sets), SIGNATURE), np.int32)
            whole = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                every = np.concatenate([sets[k] for k in full])
                at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for k, seed in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
                    whole[k, full] = mix(np.add.reduceat(mix(every ^ U64(seed)), at) + n[full].astype(np.uint64))
                small = (every >> U64(32)).astype(np.uint32) ^ every.astype(np.uint32)
                for k in range(SIGNATURE):
                    v = (small ^ _XOR[k]) * _MULTIPLY[k]
                    v ^= v >> np.uint32(15)
                    v *= np.uint32(0x85EBCA6B)
                    signature[full, k] = np.minimum.reduceat(v, at).view(np.int32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(signature.ravel()), SIGNATURE).cast(pa.list_(pa.int32()))
            hashes = [pa.array(x.view(np.int64)) for x in whole]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), *hashes, flat], ["id", "t", "n", "p", "q", "signature"])


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, p, q, signature): hash of the text, set size, two hashes of the set, min-hashes."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_feature_rows, "id long, t long, n long, p long, q long, signature array<int>")


def _linked_rows(percent: int):
    def run(batches):
        memo: dict[int, np.ndarray] = {}
        for b in batches:
            left, right = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.zeros(b.num_rows, bool)
            for i, j in steps(b.column(4)):
                sets = shingle_sets(text_bytes(b.column(4).slice(i, j - i)))
                new = [k for k in dict.fromkeys(right[i:j].tolist()) if k not in memo]
                if new:
                    at = {k: i + int(np.flatnonzero(right[i:j] == k)[0]) for k in new}
                    if len(memo) > 64:
                        memo.clear()
                        new = list(dict.fromkeys(right[i:j].tolist()))
                        at = {k: i + int(np.flatnonzero(right[i:j] == k)[0]) for k in new}
                    memo.update(zip(new, shingle_sets([b.column(5)[at[k]].as_py().encode() for k in new])))
                for k, mine in enumerate(sets, i):
                    other = memo[int(right[k])]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(keep)), b.column(3).filter(pa.array(keep))], ["a", "b"])

    return run


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and shared counts of two classes allow the similarity."""
    n, m = (F.col(a + "n"), F.col(b + "n")), F.least(a + "s", b + "s")
    return (F.least(*n) * 100 >= F.greatest(*n) * percent) & (m * 100 >= (n[0] + n[1] - m) * percent)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y, x_id, y_id) of classes, the links (a, b) of ids whose full sets are similar enough."""
    mine = texts.select(F.col("kind").alias("x"), F.col("text").alias("x_text"))
    other = texts.select(F.col("kind").alias("y"), F.col("text").alias("y_text"))
    # a centre's text goes once to each task that compares with it; GROUP partners and more have several
    tiles = pairs.groupBy("y").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("tiles"))
    dealt = pairs.join(tiles.where("tiles > 1"), "y", "left").withColumn("tile", F.pmod(F.xxhash64("x"), F.coalesce("tiles", F.lit(1))).cast("int"))
    centres = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("y", "tile").join(other, "y")
    both = dealt.join(mine, "x").join(centres, ["y", "tile"]).select("x", "y", "x_id", "y_id", "x_text", "y_text")
    return both.mapInArrow(_linked_rows(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, least): the least id that each linked id reaches; large-star and small-star rounds until nothing changes."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        near = edges.union(edges.select("v", "u"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.where("u > v").distinct()
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        out = small.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        old, edges = edges, cut(out)
        drop(old)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first())
        if state == before:
            out = edges.select(F.col("u").alias("v"), F.col("v").alias("least"))
            out._trackloom_path = edges._trackloom_path
            return out
        before = state


def _half_keys(signature: str = "signature") -> Column:
    return F.array(*(F.xxhash64(F.lit(k), *(F.col(signature)[k * ROWS + r] for r in range(ROWS))) for k in range(2 * HALVES)))


def table_keys(classes: DataFrame) -> DataFrame:
    """(table, kind, id, n): the combined keys of each class, of half keys that another class has too."""
    halves = classes.select("kind", F.posexplode(_half_keys()).alias("half", "h"))
    shared = halves.groupBy("h").agg(F.min("kind").alias("p"), F.max("kind").alias("q")).where("p < q").select("h")
    mask = spread_join(halves, shared, ["h"], ["kind"]).groupBy("kind").agg(F.collect_set("half").alias("mine"))
    mask = mask.select("kind", F.filter("mine", lambda k: k < HALVES).alias("first"), F.filter("mine", lambda k: k >= HALVES).alias("second"))
    mask = mask.where("size(first) > 0 and size(second) > 0")
    keys = classes.join(mask, "kind").select("kind", "id", "n", _half_keys().alias("keys"), F.explode("first").alias("i"), "second")
    keys = keys.select("kind", "id", "n", "keys", "i", F.explode("second").alias("j"))
    return keys.select(F.xxhash64(F.col("keys")[F.col("i")], F.col("keys")[F.col("j")]).alias("table"), "kind", "id", "n")


def _unshared_rows(batches):
    for b in batches:
        for i, j in steps(b.column(1)):
            sets = shingle_sets(text_bytes(b.column(1).slice(i, j - i)))
            kinds = np.repeat(b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(kinds)], ["h", "kind"])


def shared_counts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(kind, s): how many shingles of each class another class of `texts` has too; what any two sets have in common is no more than the lesser s."""
    alone = texts.mapInArrow(_unshared_rows, "h long, kind long").groupBy("h").agg(F.count("*").alias("c"), F.min("kind").alias("kind")).where("c = 1")
    alone = alone.groupBy("kind").agg(F.count("*").alias("alone"))
    return texts.select("kind").join(classes.select("kind", "n"), "kind").join(alone, "kind", "left").select("kind", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))


def _bitmap_rows(batches):
    for b in batches:
        for i, j in steps(b.column(1)):
            sets = shingle_sets(text_bytes(b.column(1).slice(i, j - i)))
            bits = np.zeros((len(sets), 64 * LONGS), np.uint8)
            for k, x in enumerate(sets):
                bits[k, (x % U64(64 * LONGS)).astype(np.int64)] = 1
            packed = np.packbits(bits, axis=1).view(np.int64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), LONGS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), flat, pa.array(bits.sum(1, dtype=np.int64))], ["kind", "bits", "ones"])


def _overlap_possible(a: str, b: str, percent: int) -> Column:
    """Whether bitmaps of the sets allow the similarity: what is common has common bits, but for the shingles that share a bit in one set."""
    common = sum((F.bit_count(F.col(a + "bits")[k].bitwiseAND(F.col(b + "bits")[k])) for k in range(1, LONGS)), F.bit_count(F.col(a + "bits")[0].bitwiseAND(F.col(b + "bits")[0])))
    most = common + F.least(F.col(a + "n") - F.col(a + "ones"), F.col(b + "n") - F.col(b + "ones"))
    return most * 100 >= (F.col(a + "n") + F.col(b + "n") - most) * percent


def _first_common(a: str, b: str, low: int, high: int) -> Column:
    """The first place in low .. high - 1 where two arrays of half keys agree (from 0)."""
    part = F.zip_with(F.slice(a, low + 1, high - low), F.slice(b, low + 1, high - low), lambda x, y: x == y)
    return F.array_position(part, F.lit(True)) - 1 + low


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links of an id that stands in several classes (repeated with other texts) to the ids of all of them."""
    placed = rows.where("n > 0 and id is not null").select("id", "p", "q")
    several = placed.groupBy("id").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("q").alias("q0"), F.max("q").alias("q1")).where("p0 < p1 or q0 < q1")
    found = placed.join(several.select("id"), "id").distinct().join(classes.select("p", "q", F.col("id").alias("b")), ["p", "q"])
    return found.select(F.col("id").alias("a"), "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df."""
    bounded_batches(df.sparkSession)
    rows = cut(features(df, id_col, text_col))
    classes = rows.where("n > 0 and id is not null").groupBy("p", "q").agg(F.min(F.struct("id", "t")).alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    # the numbers stand in a written table, so they don't change when a task runs again
    classes = cut(classes.select(F.monotonically_increasing_id().alias("kind"), "least.id", "least.t", "n", "p", "q", "signature"))
    keys = cut(table_keys(classes))
    several = keys.groupBy("table").agg(F.min("kind").alias("p"), F.max("kind").alias("q")).where("p < q").select("table")
    met = spread_join(keys, several, ["table"], ["kind"]).select("kind").distinct()
    # a class's text is that of the row it got its id from
    wanted = classes.join(met, "kind").select("id", "t", "kind")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("id is not null and text is not null").join(wanted, ["id", "t"])
    texts = cut(texts.groupBy("kind").agg(F.max("text").alias("text")))
    # a class with too many shingles of its own is near to no other
    able = shared_counts(texts, classes).join(classes.select("kind", "n"), "kind").where(F.col("s") * 100 >= F.col("n") * percent).select("kind", "s")
    able = cut(able)
    keyed = keys.join(able, "kind")
    member = F.struct("id", "kind", "n", "s")
    buckets = keyed.groupBy("table").agg(F.min(member).alias("least"), F.max(member).alias("most")).where("least < most")
    in_bucket = cut(spread_join(keyed, buckets.select("table", "least"), ["table"], ["kind"]))
    star = in_bucket.where(F.col("kind") != F.col("least.kind")).where(_possible("", "least.", percent))
    star = star.select(F.col("kind").alias("x"), F.col("least.kind").alias("y"), F.col("id").alias("x_id"), F.col("least.id").alias("y_id")).distinct()
    links = cut(confirm(star, texts, percent).union(_same_id(rows, classes)))
    found = components(links)
    # classes in buckets that hold several components meet again, in the first half key that a pair shares, if it also shares one of the second collection
    mine = in_bucket.join(found.withColumnRenamed("least", "part"), in_bucket.id == found.v, "left")
    mine = mine.select("table", "kind", "id", "n", "s", F.col("least.kind").alias("centre"), F.coalesce("part", "id").alias("part"))
    mixed = mine.groupBy("table").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("table")
    alone = cut(spread_join(mine, mixed, ["table"], ["kind"]).where("kind <> centre").select("kind", "id", "n", "s", "part").distinct())
    bitmaps = texts.join(alone.select("kind"), "kind").mapInArrow(_bitmap_rows, "kind long, bits array<long>, ones long")
    rest = cut(alone.join(classes.select("kind", "signature"), "kind").withColumn("halves", _half_keys()).join(bitmaps, "kind"))
    halves = rest.select("*", F.posexplode(F.slice("halves", 1, HALVES)).alias("i", "h"))
    # a half key of many classes is met in squares of GROUP by GROUP of them
    tiles = halves.groupBy("h").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("tiles")).where("tiles > 1")
    halves = spread_join(halves, tiles, ["h"], ["kind"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("kind"), F.col("tiles")).cast("int")
    a = halves.withColumn("u", own).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("a")
    b = halves.withColumn("v", own).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("b")
    equal = F.aggregate(F.zip_with("a.signature", "b.signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    once = _first_common("a.halves", "b.halves", 0, HALVES) == F.col("a.i")
    second = F.arrays_overlap(F.slice("a.halves", HALVES + 1, HALVES), F.slice("b.halves", HALVES + 1, HALVES))
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.kind") < F.col("b.kind")) & (F.col("a.part") != F.col("b.part"))
    across = a.join(b, apart & _possible("a.", "b.", percent) & _overlap_possible("a.", "b.", percent) & once & second & (equal >= LEAST_EQUAL))
    across = across.select(F.col("a.kind").alias("x"), F.col("b.kind").alias("y"), F.col("a.id").alias("x_id"), F.col("b.id").alias("y_id")).distinct()
    more = cut(confirm(across, texts, percent))
    if not more.isEmpty():
        drop(found)
        found = components(links.union(more))
    drop(keys, texts, able, in_bucket, links, alone, rest, more)
    named = classes.select("p", "q", F.col("id").alias("v")).join(found, "v", "left").select("p", "q", F.coalesce("least", "v").alias("component"))
    out = cut(spread_join(rows.select("id", "n", "p", "q"), named, ["p", "q"], ["id"], "left").select("id", "n", "component"))
    drop(rows, classes, found)
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """df's rows without those that another document of their component stands for. Rows of one id share their fate."""
    gone = near_duplicates(df, id_col, text_col, percent).where("not kept").select(F.col("id").alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_minhash_near_dedup": op5}
SQL = {
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.v WHERE r.m < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, t.m AS component_id, t.m = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(m) AS m FROM r GROUP BY v) t ON t.v = d.doc_id"""
}
