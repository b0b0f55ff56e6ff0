"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in DataFrame operations only.

A section ends with a run of two line feeds and more, a paragraph with one of line feeds, and a leaf within it after a space that follows one of a few letters and
marks, after a full stop of a script without spaces, or after 64 characters and the mark that follows; so an edit moves the cuts next to it only. Every part keeps what it ends with: the
leaves in order spell the text. A leaf's digest is its SHA-256, and each level above is the SHA-256 of its children's joined digests, so two roots are
equal if and only if the texts are (but for collisions of SHA-256). Between two trees the first differing section, in it paragraph, and in it leaf locate an edit. The likeness of two
trees is the Jaccard similarity of their distinct leaves: 1 for equal texts, 0 where no leaf is shared; an empty text has no leaf and is like an empty one only.

A null text is an empty one. Rows are ordered by id, rows of one id by a hash of their text; null ids come last. Repeated rows follow each other as
any others do. Columns other than id and text play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.ranges import range_of
from trackloom.llm.sharding import SAMPLES, quantiles, sample
from trackloom.llm.shared import documents, partitions

_LAST = (1 << 63) - 1
#: What a section, a paragraph and a leaf are; each pattern consumes any text whole.
SECTION, PARAGRAPH = r"(?s).+?(?:\n{2,}|\z)", r"(?s).+?(?:\n+|\z)"
LEAF = r"(?s).{1,64}?(?:[dnst.,;:!?] |[。、，！？]|\z)|.{1,64}"
#: A range of rows has about this many bytes, where there would not be more than 16 ranges a partition.
RANGE_BYTES = 1 << 27


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tree(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf digest>>>."""
    return F.transform(_parts(text, SECTION), lambda s: F.transform(_parts(s, PARAGRAPH), lambda p: F.transform(_parts(p, LEAF), lambda x: F.sha2(x, 256))))


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def root(of: Column) -> Column:
    return _joined(F.transform(of, lambda section: _joined(F.transform(section, _joined))))


def leaves(of: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(of)))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of distinct leaves."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def first_difference(a: Column, b: Column) -> Column:
    """The place (from 1) of the first child of two nodes that differs, null for equal nodes."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, x.isNull() & y.isNull()))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at)


def child(node: Column, at: Column, kind: str) -> Column:
    """The child at a place (from 1); one without children where there is none."""
    return F.coalesce(F.get(node, at - 1), F.array().cast(kind))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next): every row with the text of the row after it by id; after the last comes the first.

    Rows go to ranges of (id, hash of the text), cut at quantiles of a size-weighted sample. Each range also gets a copy of the first row of the range after it,
    so one exchange of the texts is enough. The driver sees some keys a range, whose number is bounded by that of the partitions.
    """
    spark = df.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sized = rows.select(F.col("o").alias("h"), "tie", (F.octet_length("text") + 64).cast("long").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = total / max(4 * n, min(total // RANGE_BYTES, 16 * n))
    cuts = sorted(set(quantiles(sample(sized, target / SAMPLES, 0), target))) if total else []
    place = range_of(F.col("o"), F.col("tie"), cuts)
    first = sorted(rows.groupBy(place.alias("r")).agg(F.min(F.struct("o", "tie")).alias("least")).collect())
    ranged = rows.withColumn("r", place).withColumn("borrowed", F.lit(False))
    if first:
        heads = [(first[k].r, *first[(k + 1) % len(first)].least) for k in range(len(first))]
        heads = spark.createDataFrame(heads, "r int, o long, tie long")
        borrowed = rows.join(F.broadcast(heads), ["o", "tie"]).groupBy("r", "o", "tie").agg(F.max("text").alias("text"))  # heads: a row a range
        ranged = ranged.unionByName(borrowed.withColumn("borrowed", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("r").orderBy("borrowed", "o", "tie", "text")
    return ranged.withColumn("next", F.lead("text").over(w)).where("not borrowed").select("id", "text", "next")


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with edited_section, edited_paragraph and edited_leaf: where the trees in columns a and b first differ; all null for equal texts."""
    rows = df.withColumn("edited_section", first_difference(F.col(a), F.col(b)))
    rows = rows.withColumn("_a", child(F.col(a), F.col("edited_section").cast("int"), "array<array<string>>")).withColumn("_b", child(F.col(b), F.col("edited_section").cast("int"), "array<array<string>>"))
    rows = rows.withColumn("edited_paragraph", F.when(F.col("edited_section") > 0, first_difference(F.col("_a"), F.col("_b"))))
    leaf = (child(F.col(x), F.col("edited_paragraph").cast("int"), "array<string>") for x in ("_a", "_b"))
    return rows.withColumn("edited_leaf", F.when(F.col("edited_section") > 0, first_difference(*leaf))).drop("_a", "_b")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_section, edited_paragraph, edited_leaf, n_leaves)."""
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), leaves(tree(F.col("next"))).alias("x"))
    rows = differences(rows, "t", "e")
    places = [F.col(f"edited_{c}").cast("long").alias(f"edited_{c}") for c in ("section", "paragraph", "leaf")]
    rows = rows.select("id", "n_chars", "edited_sha256", root(F.col("t")).alias("fingerprint"), root(F.col("e")).alias("edited_fingerprint"), leaves(F.col("t")).alias("tl"), leaves(F.col("e")).alias("el"), "x", *places)
    near = [likeness(F.col("tl"), F.col("el")).alias("near_edited"), likeness(F.col("tl"), F.col("x")).alias("near_next")]
    return rows.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, "edited_section", "edited_paragraph", "edited_leaf", F.size("tl").cast("long").alias("n_leaves"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_merkle_fingerprints": op7}
# each level is parted by what may not be divided, so that the parts put together are the text
_TREE = rf"list_transform(regexp_extract_all({{0}}, '{SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: list_transform(regexp_extract_all(p, '{LEAF.replace('{', '{{').replace('}', '}}')}'), lambda x: sha256(x))))".replace("{2,}", "{{2,}}")
_ROOT = "sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), ''))"
_NEAR = "CASE WHEN len({0}) + len({1}) = 0 THEN 1 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_AT = "list_min(list_filter(range(1, greatest(len({0}), len({1})) + 1), lambda i: {0}[i] IS DISTINCT FROM {1}[i]))::BIGINT"
SQL = {
    "op7_merkle_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id), '') AS nxt, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(nxt, 1, n_chars // 2) AS edited FROM d),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format("text")} AS t, {_TREE.format("edited")} AS e, {_TREE.format("nxt")} AS x FROM e),
l AS (SELECT *, list_distinct(flatten(flatten(t))) AS tl, list_distinct(flatten(flatten(e))) AS el, list_distinct(flatten(flatten(x))) AS xl, {_AT.format("t", "e")} AS edited_section FROM t),
m AS (SELECT *, coalesce(t[edited_section], []) AS ts, coalesce(e[edited_section], []) AS es FROM l),
n AS (SELECT *, {_AT.format("ts", "es")} AS edited_paragraph FROM m),
o AS (SELECT *, coalesce(ts[edited_paragraph], []) AS tp, coalesce(es[edited_paragraph], []) AS ep FROM n)
SELECT doc_id, n_chars, edited_sha256, {_ROOT.format("t")} AS fingerprint, {_ROOT.format("e")} AS edited_fingerprint, {_NEAR.format("tl", "el")} AS near_edited, {_NEAR.format("tl", "xl")} AS near_next,
 edited_section, edited_paragraph, {_AT.format("tp", "ep")} AS edited_leaf, len(tl)::BIGINT AS n_leaves FROM o"""
}
