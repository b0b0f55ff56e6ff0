"""Substring dedup by recompression.

A text's words are its first symbols. Each round names maximal runs of a symbol and then neighbouring pairs (a symbol of the left half
of the alphabet followed by one of the right half); a name is a hash of what it stands for, so every task gives
equal things equal names without a shared dictionary. What a symbol depends on is tracked as a span of words (those of the symbols that decided it): wherever these words
occur, in any document, the same symbol stands in the same place and depends on the same span. So equal substrings share their interior symbols.
Rounds go on until no window can hold a settled symbol of the next level.

The name of a stretch of words is made of its symbols: those of the highest level that the stretch settles, and on either side of them, level by level
down to words, those that complete it. Equal stretches have equal symbols at every level, so equal names; and the symbols spell the words, so equal names are
equal stretches, up to collisions of hashes. Two Spark rounds name stretches globally:

1. Of every window of words, the symbol of the highest level that is settled by a few words around its start becomes the window's anchor (ties by name).
   Equal windows choose equal anchors, and one anchor serves several windows, so far fewer rows than windows are shuffled. The name of the stretch that
   settles an anchor, where two documents share it, reveals that the windows around it may be repeats.
2. Only these windows are named, from the symbols that they settle; 96 bits of a shared name verify a repeat.

A name's rows are one a document at most. Names that several documents of a step share are settled in the task already: only the least document (round 2) or a
probe (round 1) goes to the name's own task, and a task remembers frequent names, so a passage in a third of all documents sends a few rows a task there.

Texts that are equal as a whole are found by their md5; all but the first of such copies take no part in the search and lose every
word (if they have a window at all).

A word goes if a window that covers it also starts in a document with a smaller id. Null and empty texts have no words;
texts under one window lose nothing; a null id counts as larger than all; rows of one id never remove each other's words.
Repeated rows get equal results. Other columns are carried along; one that has a result's name is carried as `<name>_in`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from trackloom.llm.shared import U64, Words, bounded_batches, cut, documents, fold, mix, partitions, steps, text_bytes, with_facts

#: Words before and after an anchor's start that settle its symbol; the level above which all symbols rank alike.
BEFORE, AFTER, TOP = 3, 5, 3
#: Bits of a mask of windows; a place stands above them in 64 bits.
MASK = 31
_FAR = 1 << 30
#: Names that a task remembers, and in how many documents of a step a name must stand for that.
REMEMBERED, FREQUENT = 1 << 16, 4


def name_round(name, begin, end, low, high, doc):
    """Names the runs and then the pairs of a sequence of symbols. low, high: the span of words that settles a symbol. Also: each new symbol's first and last part."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(name)) - 1
    length = last - first + 1
    run = name[first]
    run = np.where(length > 1, mix(run * U64(0x9FB21C651E98DF25) + length.astype(np.uint64)), run)
    # a run needs its members, and one symbol on either side to show that it ends; of a neighbouring run no more than that
    whole = doc[1:] == doc[:-1]
    before, after = _left(low, high, whole), _right(low, high, whole)
    low, high = (
        np.minimum(np.minimum(np.minimum.reduceat(low, first), before[0][first]), after[0][last]),
        np.maximum(np.maximum(np.maximum.reduceat(high, first), before[1][first]), after[1][last]),
    )
    doc, begin, end = doc[first], begin[first], end[last]
    same = doc[1:] == doc[:-1]
    right = (run & U64(1)).astype(bool)
    joined = np.zeros(len(run), bool)
    joined[:-1] = ~right[:-1] & right[1:] & same
    second = np.zeros(len(run), bool)
    second[1:] = joined[:-1]
    # a symbol alone shows only in the neighbour that it could have joined; a pair in both its parts
    before, after = _left(low, high, same), _right(low, high, same)
    alone = right & ~second
    other = ~right  # joined with what follows, or alone because of it
    low = np.where(alone, np.minimum(low, before[0]), np.where(other, np.minimum(low, after[0]), low))
    high = np.where(alone, np.maximum(high, before[1]), np.where(other, np.maximum(high, after[1]), high))
    at = np.flatnonzero(joined)
    run[at] = mix(run[at] * U64(0xC2B2AE3D27D4EB4F) + (run[at + 1] ^ U64(0x165667B19E3779F9)))
    end[at], last[at] = end[at + 1], last[at + 1]
    keep = ~second
    return run[keep], begin[keep], end[keep], low[keep], high[keep], doc[keep], first[keep], last[keep]


def _left(low, high, same):
    """(low, high) of the symbol before; where there is none in the text, a span that never settles."""
    a, b = np.full_like(low, -_FAR), np.full_like(high, -_FAR)
    a[1:], b[1:] = np.where(same, low[:-1], -_FAR), np.where(same, high[:-1], -_FAR)
    return a, b


def _right(low, high, same):
    a, b = np.full_like(low, _FAR), np.full_like(high, _FAR)
    a[:-1], b[:-1] = np.where(same, low[1:], _FAR), np.where(same, high[1:], _FAR)
    return a, b


class Levels:
    """All levels whose symbols a stretch of `widest` words can settle: (name, begin, low, high, first part, last part) of each symbol.

    Spans that no text settles end one word outside their text, so low and high never fall along a level.
    """

    def __init__(self, words: Words, widest: int):
        at = np.arange(len(words.hash), dtype=np.int32)
        symbols = (words.hash, at, at + np.int32(1), at, at + np.int32(1), words.doc, at, at)
        self.levels = []
        while len(at):
            name, begin, _, low, high, doc, first, last = symbols
            low, high = np.maximum(low, words.first[doc] - 1), np.minimum(high, words.last[doc] + 1)
            if not ((low >= words.first[doc]) & (high <= words.last[doc]) & (high - low <= widest)).any():
                break
            self.levels.append((name, begin, low, high, first, last))
            symbols = name_round(*symbols[:6])

    def names(self, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, symbols) of the stretches of `width` words from each start on: what its symbols are hashed to, and how many they are."""
        found, count = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
        left, right = np.full(len(start), U64(width)), np.full(len(start), U64(0x589965CC75374CC3))
        open_, start = np.arange(len(start)), start.copy()
        a, b = start, start + width
        for k, (name, *_) in enumerate(self.levels):
            inside = np.zeros(len(open_), bool)
            until, since = b, b
            if k + 1 < len(self.levels):
                _, _, low, high, first, last = self.levels[k + 1]
                up, down = np.searchsorted(low, start), np.searchsorted(high, start + width, "right")
                inside = up < down
                until, since = b.copy(), b.copy()
                until[inside], since[inside] = first[up[inside]], last[down[inside] - 1] + 1
            for h, at, end, step in ((left, a, until, 1), (right, b - 1, since - 1, -1)):
                at, which = at.copy(), np.flatnonzero(at != end)
                count[open_] += np.abs(end - at)
                while len(which):
                    h[open_[which]] = fold(h[open_[which]], name[at[which]])
                    at[which] += step
                    which = which[at[which] != end[which]]
            if not inside.any():
                break
            open_, start, a, b = open_[inside], start[inside], up[inside], down[inside]
        found[:] = mix(left ^ mix(right))
        return found, count


def order_keys(words: Words, levels: Levels) -> np.ndarray:
    """For each word the name of the highest settled symbol that starts there; higher levels sort first."""
    keys = np.zeros(len(words.hash), np.uint64)
    for k, (name, begin, low, high, _, _) in enumerate(levels.levels):
        settled = (low >= begin - BEFORE) & (high <= begin + AFTER)
        keys[begin[settled]] = (U64(max(0, TOP - k)) << U64(62)) | (name[settled] >> U64(2))
    return keys


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, mask): the chosen anchors' places, the name of the stretch that settles them, and a bit for each window that chose them:
    bit d for the window that starts BEFORE + d words before the place. Windows farther before the anchor than MASK bits tell have rows with
    a place so much earlier."""
    n = len(words.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = BEFORE + AFTER
    levels = Levels(words, size)
    keys = order_keys(words, levels)
    width = window - size + 1  # an anchor may start at window start + BEFORE .. + BEFORE + width - 1
    least, span = keys, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    m = n - window + 1
    windows = words.doc[:m] == words.doc[window - 1 :]
    out = []
    for far in range(0, width, MASK):
        chosen = np.zeros(n, np.int64)
        for d in range(far, min(width, far + MASK)):
            hit = windows & (least[BEFORE : BEFORE + m] == keys[BEFORE + d : BEFORE + d + m])
            chosen[BEFORE + d : BEFORE + d + m] |= hit.astype(np.int64) << (d - far)
        at = np.flatnonzero(chosen)
        out.append((at - far, levels.names(at - BEFORE, size)[0], chosen[at]))
    at, h, mask = (np.concatenate(x) for x in zip(*out))
    return at, h, mask


def _packed_rows(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = pa.array([None if t is None else pack.compress(t) for t in text_bytes(b.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, *b.columns[3:]], b.schema.names)


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unpack.decompress(z) for z in column.to_pylist()], pa.binary())


class Meeting:
    """What a task knows of the names that its documents share: rows (key, id, tag, at, check) for the rest to be found, one a name and document,
    however often the name stands there (its places are packed as 64-bit integers).

    A row that needs no more finding is `sure`: its tag has the sign bit, and its key is any spread one. Where `later`, it is sure if a smaller id of the
    task has the name; else, if another id has. A name that is shared here sends one row without places as a probe to its own task.
    """

    NAMES = ["key", "id", "tag", "at", "check"]
    SCHEMA = "key long, id long, tag int, at binary, check int"

    def __init__(self, later: bool):
        self.later = later
        self.names, self.checks, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _known(self, h, check):
        """(found, least id) of names in the memory."""
        if not len(self.names):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return (self.names[at] == h) & (self.checks[at] == check), self.least[at]

    def _remember(self, h, check, least):
        if len(h):
            h, check, least = (np.concatenate(x) for x in ((self.names, h), (self.checks, check), (self.least, least)))
            order = np.lexsort((least, check, h))
            h, check, least = h[order], check[order], least[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            # a memory only: what is forgotten is found by way of the name's task
            self.names, self.checks, self.least = (x[new][:REMEMBERED] for x in (h, check, least))

    def rows(self, row, h, at, ids, tags, check=None) -> pa.RecordBatch:
        check = np.zeros(len(h), np.int32) if check is None else check
        order = np.lexsort((row, check, h))
        row, h, at, check = row[order], h[order], at[order], check[order]
        name = np.ones(len(h), bool)
        name[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        new = name.copy()
        new[1:] |= row[1:] != row[:-1]
        first = np.flatnonzero(new)
        offsets = np.append(first, len(h)) * 8
        h, check, row, name = h[first], check[first], row[first], np.flatnonzero(name[first])
        mine, tag = ids[row], tags[row].astype(np.int32)
        sure, probes = np.zeros(len(h), bool), np.zeros(0, np.int64)
        if len(h):
            size = np.diff(np.append(name, len(h)))
            least, most = np.minimum.reduceat(mine, name), np.maximum.reduceat(mine, name)
            known, before = self._known(h[name], check[name])
            if self.later:
                sure = mine > np.repeat(np.where(known, np.minimum(least, before), least), size)
            else:
                shared = (least < most) | (known & ((before != least) | (before != most)))
                sure = np.repeat(shared, size)
                probes = name[shared & ~known]
            hot = size >= FREQUENT if self.later else (size >= FREQUENT) & (least < most)
            self._remember(h[name][hot], check[name][hot], least[hot])
        key = np.where(sure, mix(mine.view(np.uint64) ^ tag.astype(np.uint64)), h)
        tag = np.where(sure, tag | np.int32(-(1 << 31)), tag)
        data = at.astype("<i8").tobytes()
        places = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
        by_document = pa.array(np.argsort(row, kind="stable"))  # a document's rows side by side take less room
        columns = [x.take(by_document) for x in (pa.array(key.view(np.int64)), pa.array(mine), pa.array(tag), places, pa.array(check))]
        if len(probes):
            extra = [pa.array(h[probes].view(np.int64)), pa.array(mine[probes]), pa.array(tag[probes] & np.int32((1 << 31) - 1)), pa.array([b""] * len(probes), pa.binary()), pa.array(check[probes])]
            columns = [pa.concat_arrays(x) for x in zip(columns, extra)]
        return pa.RecordBatch.from_arrays(columns, self.NAMES)


def _places(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(places, their number in each row) of lists of packed places."""
    flat, sizes = lists.flatten(), pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(pa.compute.binary_length(flat).to_numpy(zero_copy_only=False) // 8)))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(flat.to_pylist()), "<i8"), before[ends] - before[ends - sizes]


def _width(window: int) -> int:
    """Bits of a mask."""
    if window < BEFORE + AFTER:
        raise ValueError(f"a window has {BEFORE + AFTER} words or more, not {window}")
    return min(MASK, window - BEFORE - AFTER + 1)


def _anchor_rows(window: int):
    """Rows of the anchors' names: a place in `at` has, in its low bits, the mask of the windows that chose the anchor."""
    width = _width(window)

    def run(batches):
        meeting = Meeting(False)
        for b in batches:
            ids, tags, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _unpacked(b.column(2))
            for i, j in steps(texts):
                w = Words(texts.slice(i, j - i).to_pylist())
                at, h, mask = anchors(w, window)
                row = w.doc[at]
                yield meeting.rows(row, h, (at - w.first[row]) << width | mask, ids[i:j], tags[i:j])

    return run


def _window_rows(window: int):
    """Rows of the names of the windows that chose a shared anchor; a place is a window's start."""
    width = _width(window)

    def run(batches):
        meeting = Meeting(True)
        for b in batches:
            ids, tags, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _unpacked(b.column(2))
            for i, j in steps(texts):
                w = Words(texts.slice(i, j - i).to_pylist())
                held, many = _places(b.column(3).slice(i, j - i))
                at = (held >> width) + np.repeat(w.first, many)
                mine = np.zeros(len(w.hash), bool)
                for d in range(width):
                    mine[at[(held >> d & 1).astype(bool)] - BEFORE - d] = True
                start = np.flatnonzero(mine)
                row = w.doc[start]
                inside = start + window <= w.last[row]
                start, row = start[inside], row[inside]
                h, _ = Levels(w, window).names(start, window)
                yield meeting.rows(row, h, start - w.first[row], ids[i:j], tags[i:j], check_bits(w, start, window))

    return run


def check_bits(words: Words, start: np.ndarray, width: int) -> np.ndarray:
    """32 more bits of a stretch's name, from its words."""
    h = np.full(len(start), U64(0x2545F4914F6CDD1D))
    for k in range(width):
        h = fold(h, words.hash[start + k])
    return (mix(h) >> U64(33)).astype(np.int32)


def _kept_rows(window: int, names: list[str], digest: bool):
    """Rows of the words that are left and of the text itself, unpacked; with digest of the words' SHA-256 only."""

    def run(batches):
        for b in batches:
            texts, starts = _unpacked(b.column(2)), b.column(3)
            for i, j in steps(texts):
                w = Words(texts.slice(i, j - i).to_pylist(), spans=True)
                copy = np.array([bool(x) for x in b.column(b.num_columns - 1).slice(i, j - i).to_pylist()], bool) & (w.last - w.first >= window)
                found, many = _places(starts.slice(i, j - i))
                at = found + np.repeat(w.first, many)
                diff = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(diff, at, 1)
                np.add.at(diff, at + window, -1)
                gone = (np.cumsum(diff[:-1]) > 0) | copy[w.doc]
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[w.last] - total[w.first]
                kept = []
                for first, last in zip(w.first, w.last):
                    mine = np.flatnonzero(~gone[first:last]) + first
                    kept.append(b" ".join([w.raw[s:e] for s, e in zip(w.start[mine].tolist(), w.end[mine].tolist())]))
                left = [pa.array([hashlib.sha256(t).hexdigest() for t in kept])] if digest else [pa.array(kept, pa.binary()).cast(pa.string()), texts.slice(i, j - i).cast(pa.string())]
                out = [*left, pa.array((w.last - w.first).astype(np.int64)), pa.array(removed.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*out, *(b.column(k).slice(i, j - i) for k in range(4, b.num_columns - 1))], names)

    return run


def _shared(rows: DataFrame, later: bool) -> DataFrame:
    """(id, tag, at list) of the sure rows and of those whose name stands under two ids or, if `later`, under a smaller id. A name's ids are never gathered."""
    w = Window.partitionBy("key", "check")
    met = rows.repartition(partitions(rows.sparkSession), "key").withColumn("least", F.min("id").over(w)).withColumn("most", F.max("id").over(w))
    found = met.where((F.col("tag") < 0) | ((F.length("at") > 0) & (F.col("id") > F.col("least") if later else F.col("least") < F.col("most"))))
    return found.groupBy("id", F.col("tag").bitwiseAND(F.lit((1 << 31) - 1)).alias("tag")).agg(F.collect_list("at").alias("at"))


def _copies(texts: DataFrame) -> DataFrame:
    """(id, tag) of texts that also stand under a smaller id: equal texts by their md5."""
    named = texts.where("length(text) > 0").select("id", "tag", F.unhex(F.md5("text")).alias("name"))
    copies = with_facts(named, ["name"], ["id", "tag"], least=("min", "id")).where("id > least")
    return copies.select("id", "tag", F.lit(True).alias("copy")).distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, digest: bool = False) -> DataFrame:
    """df's columns (with digest only the id) with `kept` (the remaining words joined by one space; with digest their SHA-256), `n_words` and `n_removed`."""
    results = ["kept", "n_words", "n_removed"]
    own = [f"{c}_in" if c in results else c for c in (df.columns if not digest else [id_col])]
    return _deduplicated(df, id_col, text_col, window, digest).toDF(*own, *results)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", window: int = 13) -> DataFrame:
    """df's columns; texts that lose words become the remaining ones, joined by one space, and their size in characters follows. Other texts stay as they are."""
    out, lost = _deduplicated(df, id_col, text_col, window, False), F.col("n_removed") > 0
    new = {text_col: F.col("kept"), size_col: F.char_length("kept").cast("long")}
    return out.select(*((F.when(lost, new[c]).otherwise(F.col(f"c{k}")) if c in new else F.col(f"c{k}")).alias(c) for k, c in enumerate(df.columns)))


def _deduplicated(df: DataFrame, id_col: str, text_col: str, window: int, digest: bool) -> DataFrame:
    """(c0, c1, ..., kept, n_words, n_removed)."""
    spark = df.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    # rows of one id are told apart by 31 bits of their text's hash; where an id has one text, the tag is 0 and takes no room
    whose, hashed = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.shiftrightunsigned(F.xxhash64(text_col), 33).cast("int")
    several = df.select(whose.alias("id"), hashed.alias("tag")).groupBy("id").agg(F.min("tag").alias("p"), F.max("tag").alias("q")).where("p < q")
    several = cut(several.select(F.col("id").alias("several")))
    identity = [whose.alias("id"), hashed.alias("tag"), F.col(text_col).alias("text")]
    # the text travels packed only, and its own column is made of that
    carried = {f"c{k}": c for k, c in enumerate(df.columns) if c != text_col} if not digest else {"c0": id_col}
    rest = [F.col(f"`{c}`").alias(name) for name, c in carried.items()]
    every = ["id", "tag", "text", "at", *carried]
    source = df.select(*identity, *rest).join(several, F.col("id") == F.col("several"), "left")  # seldom any, so Spark broadcasts them
    source = source.withColumn("tag", F.when(F.col("several").isNotNull(), F.col("tag")).otherwise(0)).drop("several")
    # one exchange of the packed texts, by id, serves the three passes; the lists joined to it are built into hash tables, so texts are never sorted
    packed = StructType([source.schema["id"], source.schema["tag"], StructField("text", BinaryType()), *source.schema.fields[3:]])
    moved = source.mapInArrow(_packed_rows, packed).where("id is not null and tag is not null").repartition(n, "id", "tag")
    whole = moved.join(_copies(source).hint("shuffle_hash"), ["id", "tag"], "left")
    first = whole.where("copy is null").withColumn("at", F.lit(None).cast("array<binary>")).select(*every)
    found = _shared(first.mapInArrow(_anchor_rows(window), Meeting.SCHEMA), False)
    second = moved.join(found.hint("shuffle_hash"), ["id", "tag"]).select(*every)
    repeats = _shared(second.mapInArrow(_window_rows(window), Meeting.SCHEMA), True)
    third = whole.join(repeats.hint("shuffle_hash"), ["id", "tag"], "left").select(*every, "copy")
    made = [StructField("kept", StringType()), *([] if digest else [StructField(f"c{df.columns.index(text_col)}", StringType())]), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    schema = StructType([*made, *(third.schema[c] for c in carried)])
    out = third.mapInArrow(_kept_rows(window, schema.names, digest), schema)
    return out.select(*(f"c{k}" for k in range(1 if digest else len(df.columns))), "kept", "n_words", "n_removed")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9}
SQL = {
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
r AS (SELECT doc_id, list(DISTINCT i + d) AS gone FROM (SELECT p.doc_id, p.i FROM p JOIN m USING (s) WHERE p.doc_id > m.least), (SELECT unnest(range(0, 13)) AS d) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
 CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
}
