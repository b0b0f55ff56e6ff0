"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's share of the tokens (words; letters where a script has no spaces) is raised to an exponent and normalised. The exponent is found by bisection: the least one (the flattest mixture) that
repeats no source more than `repeats` times, or the one whose mixture has a given entropy. The budget is such that the source that is
cut most is still drawn once in full, unless a budget in tokens is given; so by default no document is left out and the others are repeated.

A source's quota is realised in passes. Its documents are dealt by a hash to about the square root of their number of blocks; each pass permutes
blocks and the documents in a block by further hashes. Full passes take everything; the last takes whole blocks in order, then of
one block the documents in order, as long as the quota lasts. Per source this leaves four numbers at the driver (their count is the number of
sources), and drawing is a filter and an explode without any shuffle of the texts, deterministic under recomputation.

A null source counts as the source "". Null texts have no words; a source without any words is drawn once. Repeated rows are drawn together. An empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from trackloom.llm.shared import cut, documents

#: Sources up to this number are joined by broadcast; beyond it Spark chooses.
FEW = 10_000
ROUNDS = 60


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    most = max(sizes.values())
    raised = {s: (t / most) ** exponent for s, t in sizes.items()}
    total = sum(raised.values())
    return {s: x / total for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """In units of the greatest possible, log(number of sources)."""
    return -sum(w * math.log(w) for w in weights.values() if w) / math.log(len(weights)) if len(weights) > 1 else 1.0


def repetition(sizes: dict[str, float], weights: dict[str, float], budget: float | None) -> float:
    whole = budget or max(sizes[s] / weights[s] for s in sizes)
    return max(whole * weights[s] / sizes[s] for s in sizes)


def exponent(sizes: dict[str, float], repeats: float | None, target: float | None, budget: float | None = None) -> float:
    """By bisection in 0 .. 1: entropy falls and repetition falls as the exponent grows."""
    low, high = 0.0, 1.0
    if target is not None:
        def too_flat(x):
            return entropy(tempered(sizes, x)) > target
    else:
        def too_flat(x):
            return repetition(sizes, tempered(sizes, x), budget) > repeats
    if not too_flat(low):
        return low
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


#: Letters of scripts that are written without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han. Each counts as a token.
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"


def words(text: str) -> Column:
    """Tokens of a text: letters of unspaced scripts, and runs of anything else but spaces.

    Classes of many ranges are slow, so a text without any letter from the first of these scripts on is counted by runs alone (\\s is 0x20 and 0x09-0x0D)."""
    runs, both = F.regexp_count(F.col(text), F.lit(r"\S+")), F.regexp_count(F.col(text), F.lit(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"))
    return F.coalesce(F.when(F.col(text).rlike(r"[\u0E00-\uFFFF]"), both).otherwise(runs), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    return F.xxhash64(*parts)


class Mixer:
    """The plan of a mixture over df; `draw` applies it."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, seed: int = 1):
        if repeats is not None and repeats < 1 or (repeats is None and target_entropy is None):
            raise ValueError("a repetition limit of 1 or more, or a target entropy, is needed")
        self.columns, self.seed = (id_col, text_col, source_col), seed
        self.rows = cut(df.select(F.col(id_col).alias("id"), self._source().alias("src"), self._key().alias("key"), words(text_col).alias("tokens")))
        totals = self.rows.groupBy("src").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
        sizes = {r.src: float(r.t) for r in totals if r.t}
        self.exponent = exponent(sizes, repeats, target_entropy, budget) if sizes else 1.0
        self.weights = tempered(sizes, self.exponent) if sizes else {}
        whole = (budget or max(sizes[s] / self.weights[s] for s in sizes)) if sizes else 0.0
        plan = []
        for r in totals:
            quota = whole * self.weights[r.src] if r.t else 0.0
            passes = int(quota / r.t + 1e-9) if r.t else 1
            plan.append((r.src, max(1, math.isqrt(r.n)), passes, max(0.0, quota - passes * r.t) if r.t else 0.0, self.weights.get(r.src, 0.0)))
        schema = StructType([StructField("src", StringType()), StructField("blocks", LongType()), StructField("passes", IntegerType()), StructField("rest", DoubleType()), StructField("weight", DoubleType())])
        spark = df.sparkSession
        small = (lambda d: F.broadcast(d)) if len(plan) <= FEW else (lambda d: d)
        planned = self.rows.join(small(spark.createDataFrame(plan, schema)), "src").withColumn("block", self._block())
        blocks = planned.where("rest > 0").groupBy("src", "block", "passes", "rest").agg(F.sum("tokens").alias("t")).withColumn("turn", self._turn(F.col("passes")))
        before = F.sum("t").over(Window.partitionBy("src").orderBy("turn", "block")) - F.col("t")
        edge = blocks.withColumn("before", before).where("before < rest and before + t >= rest").groupBy("src").agg(F.min(F.struct("turn", "block", "before")).alias("e"))
        edge = edge.select("src", F.col("e.turn").alias("edge_turn"), F.col("e.block").alias("edge_block"), F.col("e.before").alias("before"))
        inside = planned.join(small(edge), "src").where("block = edge_block").withColumn("place", self._place(F.col("passes")))
        upto = F.sum("tokens").over(Window.partitionBy("src").orderBy("place"))
        last = inside.withColumn("upto", upto).where("before + upto <= rest").groupBy("src").agg(F.max("place").alias("last_place"))
        found = {r.src: (r.edge_turn, r.edge_block) for r in edge.collect()}
        cuts = {r.src: r.last_place for r in last.collect()}
        full = StructType([*schema.fields, StructField("edge_turn", LongType()), StructField("edge_block", LongType()), StructField("last_place", LongType())])
        self.plan = small(spark.createDataFrame([(*p, *found.get(p[0], (None, None)), cuts.get(p[0])) for p in plan], full))

    def _source(self) -> Column:
        return F.coalesce(F.col(self.columns[2]).cast("string"), F.lit(""))

    def _key(self) -> Column:
        return F.xxhash64(self.columns[0], self.columns[1], F.lit(self.seed))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks"))

    @staticmethod
    def _turn(which: Column) -> Column:
        """A block's turn in a pass."""
        return F.xxhash64("src", "block", which)

    @staticmethod
    def _place(which: Column) -> Column:
        """A document's place in its block in a pass."""
        return F.xxhash64("key", which, F.lit("place"))

    def draw(self, rows: DataFrame) -> DataFrame:
        """rows (with src and key) joined to the plan, one row for each time that they are drawn, with `pass`, `turn` and `place`."""
        out = rows.join(self.plan, "src").withColumn("block", self._block())
        turn = self._turn(F.col("passes"))
        partial = (F.col("rest") > 0) & (
            F.col("edge_turn").isNull()  # the quota outlasts every block
            | (turn < F.col("edge_turn"))
            | ((turn == F.col("edge_turn")) & (F.col("block") < F.col("edge_block")))
            | ((F.col("block") == F.col("edge_block")) & (self._place(F.col("passes")) <= F.col("last_place")))
        )
        times = F.col("passes") + F.coalesce(partial, F.lit(False)).cast("int")
        out = out.withColumn("times", times).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        return out.withColumn("turn", self._turn(F.col("pass"))).withColumn("place", self._place(F.col("pass")))

    def apply(self, df: DataFrame) -> DataFrame:
        """df's rows, each as often as it is drawn."""
        named = [f"c{k}" for k in range(len(df.columns))]
        rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, named)), self._source().alias("src"), self._key().alias("key"))
        return self.draw(rows).select(*(F.col(n).alias(c) for c, n in zip(df.columns, named)))

    def schedule(self) -> DataFrame:
        """(id, source, tokens, weight, pass, block, place): every draw, with the document's number in its block and pass."""
        w = Window.partitionBy("src", "pass", "block").orderBy("place", "id")
        return self.draw(self.rows).select("id", F.col("src").alias("source"), "tokens", "weight", "pass", "block", F.row_number().over(w).alias("place"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixer(documents(spark, sf_dir)).schedule().withColumnRenamed("id", "doc_id")


QUERIES = {"op10_source_mixing": op10}
SQL: dict[str, str] = {}
