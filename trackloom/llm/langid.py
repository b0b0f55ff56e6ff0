"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into phrases, each the longest
match that occurs somewhere in a language's labelled text; the language that needs the fewest phrases, normalised to
bits a character (phrases * log2(size of the labelled text) / characters), wins. Letters are lower-cased, everything between them is one space.

Every letter of the labelled text has a class of its own; the automata's edges lie in one array by state + class (double array). Where a character does
not continue a phrase, a table of each language's first edges leads to the state of a new phrase and marks the step. Texts are cut into blocks of equal length, each parsed on its own, and all blocks of a batch advance together, one
character a step, for all languages at once; the blocks' phrases are summed, so every character of a text counts.

The labelled text is a bounded sample: about `characters` a language, of texts of every length, each cut into pieces of at most `longest` characters, in
the order of a hash of id, text and piece (copies of both once). Every label is learned; with more than `languages` of them each has fewer characters, so
that the sample stays as large. Null texts and texts without a letter are `und` with score 0. Ties go to the
label with more labelled texts. Null labels and null ids are never learned from; a table without labels gives `und` only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from trackloom.llm.shared import bounded_batches, documents, steps

#: Characters of a block; states that advance together.
BLOCK, AT_ONCE = 256, 1 << 20
_SPACE, _FIRST = 1, 2


class _Tables:
    """For each code point: whether it is a letter, and its lower case."""

    letter = lower = None

    @classmethod
    def load(cls):
        if cls.letter is None:
            chars = [chr(i) for i in range(0x110000)]
            cls.letter = np.array([c.isalpha() for c in chars])
            cls.lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.int32)
        return cls


def points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def normalised(text: str) -> str:
    """Lower-cased letters, everything else between them one space."""
    t = _Tables.load()
    p = points(text)
    p = np.where(t.letter[p], t.lower[p], 32)
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    return "".join(map(chr, p[keep]))


class SuffixAutomaton:
    """Of several strings; state 0 is the start, and every path from it spells a substring of one of them."""

    def __init__(self, texts):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)

    def _new(self, length, link, edges):
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p, q, c):
        """The state of the longest string of p followed by c, parted from longer strings of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last, c):
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new


def _double_array(src: np.ndarray, label: np.ndarray, n_states: int, n_classes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, check) of edges sorted by state: bases differ, and the edge of state s by class c alone has the place base[s] + c, where check is base[s].

    Bases are tried by chance, the states with most edges first, those with few all at once. A state without edges has the base -1.
    """
    rng = np.random.default_rng(1)
    base, check, taken = np.full(n_states, -1, np.int64), np.full(width + n_classes, -1, np.int32), np.zeros(width, bool)
    degree = np.bincount(src, minlength=n_states)
    first = np.cumsum(degree) - degree
    order = np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)]
    many = int(np.count_nonzero(degree > 8))
    for s in order[:many].tolist():
        mine = label[first[s] : first[s] + degree[s]]
        while True:
            b = int(rng.integers(width))
            if not taken[b] and (check[b + mine] < 0).all():
                break
        base[s], taken[b], check[b + mine] = b, True, b
    for d in range(8, 0, -1):
        left = order[many:][degree[order[many:]] == d]
        while len(left):
            b = rng.integers(width, size=len(left))
            places = b[:, None] + label[first[left][:, None] + np.arange(d)]
            ok = ~taken[b] & (check[places] < 0).all(1)
            left_now, b, places = np.flatnonzero(ok), b[ok], places[ok]
            # of tries that meet, the later ones wait for the next turn: all places of a try must be its own
            _, at = np.unique(places.ravel(), return_index=True)
            own = np.bincount(at // d, minlength=len(b)) == d
            alone = np.zeros(len(b), bool)
            alone[np.unique(b, return_index=True)[1]] = True
            own &= alone
            base[left[left_now[own]]], taken[b[own]] = b[own], True
            check[places[own]] = b[own][:, None]
            left = np.delete(left, left_now[own])
    return base, check


class Model:
    """names; classes: code point -> class. A state is its base: check[state + class] is the state where it has that edge, goto[state + class] then
    2 * next state. Otherwise fresh[language * classes + class] is 2 * the state after a new phrase's first character + 1."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {k: [t for x in v if (t := normalised(x)).strip()] for k, v in samples.items()}
        self.names = [k for k, v in texts.items() if v]  # without a letter nothing is learned
        counts: dict[str, int] = {}
        for t in (t for v in texts.values() for t in v):
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        counts.pop(" ", None)
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        own = {c: k for k, c in enumerate(letters, _FIRST)} | {" ": _SPACE}
        self.n_classes = len(letters) + _FIRST + 1
        self.pad = self.n_classes - 1
        t = _Tables.load()
        self.classes = np.where(t.letter, 0, _SPACE).astype(np.int32)
        for c, k in own.items():
            if c != " ":
                self.classes[ord(c)] = k
        self.classes = np.where(t.letter, self.classes[t.lower], _SPACE).astype(np.int32)
        self.bits, roots, edges, n_states = [], [], [], 0
        for name in self.names:
            a = SuffixAutomaton([[own[c] for c in x] for x in texts[name]])
            sizes = np.fromiter(map(len, a.next), np.int64, len(a.next))
            labels = np.fromiter((c for e in a.next for c in e), np.int64, sizes.sum())
            ends = np.fromiter((q for e in a.next for q in e.values()), np.int64, sizes.sum())
            edges.append((np.repeat(np.arange(len(sizes)), sizes) + n_states, labels, ends + n_states))
            roots.append(n_states)
            n_states += len(sizes)
            self.bits.append(math.log2(2 + sum(map(len, texts[name]))))
        src, label, end = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
        width = 3 * len(src) + self.n_classes
        base, check = _double_array(src, label, n_states, self.n_classes, width)
        # no phrase is open, any character begins one: that state of each language has no edges, like those at the end of a text
        idle = width + np.arange(len(self.names))
        language = np.repeat(np.arange(len(self.names)), np.diff([*roots, n_states]))
        base = np.where(base < 0, idle[language] if len(idle) else base, base)
        self.starts = idle.astype(np.int32)
        self.check = np.concatenate((check, np.full(len(idle), -1, np.int32)))
        self.goto = np.zeros(len(self.check), np.int32)
        self.goto[base[src] + label] = 2 * base[end]
        fresh = np.repeat(2 * idle[:, None] + 1, self.n_classes, 1)
        root = np.isin(src, roots)
        fresh[language[src[root]], label[root]] = 2 * base[end[root]] + 1
        fresh[:, self.pad] = 2 * idle
        self.fresh = fresh.astype(np.int32).ravel()

    def phrases(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of texts given as one array of classes and their sizes."""
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        begin = np.cumsum(sizes) - sizes
        n = int(blocks.sum())
        held = np.full(n * BLOCK, self.pad, np.int32)
        held[np.arange(len(classes)) + np.repeat(first * BLOCK - begin, sizes)] = classes
        columns = np.ascontiguousarray(held.reshape(n, BLOCK).T)
        count = np.zeros((len(self.names), n), np.int32)
        languages = np.arange(len(self.names), dtype=np.int64)[:, None] * self.n_classes
        step = max(1, AT_ONCE // max(1, len(self.names)))
        for i in range(0, n, step):
            part = columns[:, i : i + step]
            state = np.repeat(self.starts[:, None], part.shape[1], 1)
            for k in range(BLOCK):
                at = state + part[k]
                v = np.where(self.check[at] == state, self.goto[at], self.fresh[languages + part[k]])
                count[:, i : i + step] += v & 1
                state = v >> 1
        out = np.zeros((len(sizes), len(self.names)), np.int64)
        some = np.flatnonzero(blocks)
        if len(some):
            out[some] = np.add.reduceat(count, first[some], axis=1).T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        t = _Tables.load()
        whole = [x or "" for x in texts]
        p = points("".join(whole))
        doc = np.repeat(np.arange(len(whole)), [len(x) for x in whole])
        lettered = np.bincount(doc, t.letter[p], len(whole)) > 0
        c = self.classes[p]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != _SPACE) | (c[:-1] != _SPACE) | (doc[1:] != doc[:-1])
        c, sizes = c[keep], np.bincount(doc[keep], minlength=len(whole))
        if not self.names:
            return ["und"] * len(whole), [0.0] * len(whole), lettered.tolist()
        bits = self.phrases(c, sizes) * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(1)
        least = bits.min(1)
        weight = 2.0 ** (4 * (least[:, None] - bits))
        score = 1 / weight.sum(1)
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0).tolist(), lettered.tolist()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", characters: int = 24_000, longest: int = 1500, languages: int = 64) -> Model:
    """A model of a bounded sample: pieces of texts until `characters` of a language are reached, or its share of languages * characters where there are more."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    rows = rows.where("id is not null and lang is not null").withColumn("size", F.length("text")).withColumn("hash", F.xxhash64("id", "text")).where("size > 0")
    place = lambda k: F.pmod(F.xxhash64("hash", k), F.lit(1 << 30))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(place(F.lit(0))).alias("least")).orderBy(F.desc("n"), "lang").collect()
    if not found:
        return Model({})
    characters = max(1, min(characters, characters * languages // len(found)))
    longest = min(longest, characters)
    # a piece is drawn by its place, before it is cut out of its text
    pieces = rows.select("hash", "lang", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest).cast("int"))).alias("k"))
    share = labelled.sparkSession.createDataFrame([(r.lang, max(r.least, int((1 << 30) * min(1.0, 2 * characters / r["size"])))) for r in found], "lang string, share long")
    drawn = pieces.withColumn("place", place("k")).join(F.broadcast(share), "lang").where("place <= share").select("lang", "place", F.substring("text", F.col("k") * longest + 1, F.lit(longest)).alias("text"))
    samples: dict[str, list[str]] = {r.lang: [] for r in found}
    room = dict.fromkeys(samples, characters)
    for r in drawn.distinct().orderBy("place", "text", "lang").collect():
        if room[r.lang] > 0:
            samples[r.lang].append(r.text)
            room[r.lang] -= len(r.text)
    return Model(samples)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, lang_pred, score) for every whole text; `und` where it is null or has no letter."""
    out = _predicted(df, model, text_col, (id_col, *carry)).drop("lettered")
    return out.toDF("id", *carry, "lang_pred", "score")


def recognised(df: DataFrame, model: Model, label_col: str, text_col: str = "text") -> DataFrame:
    """df's rows whose text has a letter, whatever the model knows; a null label becomes the predicted one."""
    out = _predicted(df, model, text_col, tuple(df.columns)).where("lettered")
    return out.select(*(F.coalesce(f"c{k}", "pred" if c == label_col else f"c{k}").alias(c) for k, c in enumerate(df.columns)))


def _predicted(df: DataFrame, model: Model, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    put = df.select(F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))
    schema = StructType([*put.schema.fields[1:], StructField("pred", StringType()), StructField("score", DoubleType()), StructField("lettered", BooleanType())])

    def run(batches):
        m = shared.value
        for b in batches:
            for i, j in steps(b.column(0), 1 << 19):
                names, scores, lettered = m.predict(b.column(0).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())], schema.names)

    return put.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, carry=("held_out",)).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_language_id": op1}
SQL: dict[str, str] = {}
