"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are the distinct hashes of its lower-cased words (runs of letters, digits and bytes above 127). The model has one weight a hash, shared by all thresholds, and
ordered thresholds between the grades 0 .. K: P(grade > k) = sigmoid(w . x - threshold_k). It is fitted to a bounded sample of labelled
documents by gradient steps (Adam) on the likelihood with a quadratic penalty, over the words that a likelihood-ratio test finds telling. Every whole text then gets its expected severity, the sum over k of
P(grade > k), divided by K.

Grades of `labels`: 0 not toxic, 1 toxic, 2 toxic and of quality 0. Null and empty texts have no features, so only the thresholds
speak. Null labels and null ids are never learned from; of repeated labels of one document each counts. With no labels, or one grade
only, severity is 0. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.shared import U64, Words, bounded_batches, cut, documents, steps

BUCKETS = 1 << 18
#: Labelled documents that are fitted at most; weights of words in fewer of them stay 0.
SAMPLE, LEAST_DOCUMENTS = 20_000, 3
#: Least likelihood ratio of a word that is fitted: the 0.999 quantile of chi-squared with one degree of freedom.
TELLING = 10.83
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket): the distinct pairs, sorted."""
    w = Words([t.lower().encode() if t else b"" for t in texts], separators=_OTHER)
    pairs = np.unique(w.doc.astype(np.int64) << 18 | (w.hash >> U64(46)).astype(np.int64))
    return pairs >> 18, pairs & (BUCKETS - 1)


def _feature_rows(batches):
    for b in batches:
        doc, bucket = features(b.column(1).to_pylist())
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["grade", "x"])


def telling(grades: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The buckets whose presence depends on a threshold by the likelihood-ratio test; chance alone passes one in a thousand."""
    n, found = len(grades), np.bincount(bucket, minlength=BUCKETS).astype(float)
    out = np.zeros(BUCKETS, bool)
    for c in range(int(grades.max(initial=0))):
        above = (grades > c).astype(float)
        with_it, total = np.bincount(bucket, above[doc], BUCKETS), above.sum()
        ratio = np.zeros(BUCKETS)
        for seen, mean in ((with_it, found * total / n), (found - with_it, found * (n - total) / n), (total - with_it, (n - found) * total / n), (n - total - found + with_it, (n - found) * (n - total) / n)):
            ratio += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(mean, 1e-9)) * (seen > 0)
        out |= ratio >= TELLING
    return out & (found >= LEAST_DOCUMENTS)


class Model:
    """weights by bucket, and the thresholds of grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    @classmethod
    def fit(cls, grades: np.ndarray, doc: np.ndarray, bucket: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 0.3) -> Model:
        k = int(grades.max(initial=0))
        if k == 0 or (grades == grades[0]).all():
            return cls(np.zeros(BUCKETS), np.zeros(0))
        used = telling(grades, doc, bucket)[bucket]
        names, column = np.unique(bucket[used], return_inverse=True)
        doc, n, width = doc[used], len(grades), len(names)
        share = np.clip([(grades > c).mean() for c in range(k)], 1e-6, 1 - 1e-6)
        w, cuts = np.zeros(width), np.log((1 - share) / share)
        row = np.arange(n)
        m, v = np.zeros(width + k), np.zeros(width + k)
        for t in range(1, steps + 1):
            score = np.bincount(doc, w[column], n)
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
            ends = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
            mass = np.maximum(ends[row, grades] - ends[row, grades + 1], 1e-9)
            slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
            lower, upper = slope[row, grades] / mass / n, slope[row, grades + 1] / mass / n
            by_cut = [(lower * (grades == c + 1) - upper * (grades == c)).sum() for c in range(k)]
            g = np.concatenate([np.bincount(column, (upper - lower)[doc], width) + penalty / n * w, by_cut])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
            w = w - step[:width]
            cuts = np.maximum.accumulate(cuts - step[width:])  # thresholds keep their order
        weights = np.zeros(BUCKETS)
        weights[names] = w
        return cls(weights, cuts)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """(texts, K): P(grade > k)."""
        doc, bucket = features(texts)
        score = np.bincount(doc, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def fit(graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` graded documents, those with the least hashes of their ids; the driver gets their features."""
    bounded_batches(graded.sparkSession)
    rows = graded.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).select(F.col(grade_col).cast("int").alias("grade"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    got = rows.orderBy("place").limit(sample).select("grade", "text").mapInArrow(_feature_rows, "grade int, x array<int>").toArrow()
    if not got.num_rows:
        return Model(np.zeros(BUCKETS), np.zeros(0))
    x = got.column("x").combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    size = x.value_lengths().to_numpy(zero_copy_only=False)
    return Model.fit(got.column("grade").to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), x.flatten().to_numpy(zero_copy_only=False))


def grade(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, severity, grade, toxic): expected severity in 0 .. 1, the likeliest grade, and whether P(grade > 0) reaches `least`."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed in size

    def run(batches):
        m = shared.value
        for b in batches:
            for i, j in steps(b.column(1)):
                p = m.predict(b.column(1).slice(i, j - i).to_pylist())
                n, k = p.shape
                ends = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
                first = p[:, 0] if k else np.zeros(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p.sum(1) / max(k, 1)), pa.array((ends[:, :-1] - ends[:, 1:]).argmax(1).astype(np.int32)), pa.array(first >= least)], ["id", "severity", "grade", "toxic"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, severity double, grade int, toxic boolean")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade) of the labelled documents drawn for fitting."""
    drawn = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1).alias("grade"))
    drawn = cut(drawn.orderBy(F.xxhash64("doc_id"), "grade").limit(SAMPLE))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # SAMPLE rows at most


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grade(docs, fit(graded(docs, documents(spark, sf_dir, "labels")))).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_toxicity": op4}
SQL: dict[str, str] = {}
