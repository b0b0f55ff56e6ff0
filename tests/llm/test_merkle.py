import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.llm import merkle

MARKS, STOPS, LONGEST = "dnst.,;:!?", "。、，！？", 64


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lines(text, feeds):
    """Parts that end with a run of that many line feeds or more (read from the rule, character by character)."""
    out, k = [], 0
    while k < len(text):
        j = k + 1
        while j < len(text):
            run = len(text) - j - len(text[j:].lstrip("\n"))
            if run >= feeds:
                j += run
                break
            j += 1
        out.append(text[k:j])
        k = j
    return out


def pieces(text):
    out, k = [], 0
    while k < len(text):
        for size in range(1, LONGEST + 1):
            at = k + size
            if at >= len(text):
                at = len(text)
                break
            if text[at] in MARKS and text[at + 1 : at + 2] == " ":
                at += 2
                break
            if text[at] in STOPS:
                at += 1
                break
        out.append(text[k:at])
        k = at
    return out


def tree(text):
    return [[pieces(p) for p in lines(s, 1)] for s in lines(text, 2)]


def root(t):
    return sha("".join(sha("".join(sha("".join(map(sha, p))) for p in s)) for s in t))


def near(a, b):
    a, b = ({x for s in t for p in s for x in p} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def key(row):
    """By id, nulls last, then Spark's hash of the text."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
    return (row[0] if row[0] is not None else (1 << 63) - 1, h - (1 << 64) if h >> 63 else h)


def brute(docs):
    rows = sorted(docs, key=key)
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i if i is not None else 1 << 63, len(t), sha(e), root(tree(t)), root(tree(e)), near(tree(t), tree(e)), near(tree(t), tree(nxt))))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = merkle.fingerprints(df).collect()
    return sorted((r.id if r.id is not None else 1 << 63, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want))


def test_against_brute_force(spark):
    docs = [(7 * k % 101, f"Line {k}. More of it.\n\nSection {k % 5}\nè🙂 {k}. End" * (k % 4)) for k in range(101)]
    docs += [(None, f"last {k % 3}") for k in range(9)] + [(500, None), (501, ""), (502, "a. b\n\n\nc"), (502, "a. b\n\n\nc"), (502, "other"), (503, "x")]
    docs += [(600, "x" * 5000), (601, "。".join(["言葉"] * 70)), (602, "\n\n\n \n"), (603, "word " * 20_000)]
    same(run(spark, docs), brute(docs))


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in merkle.documents(spark, sf).collect()]
    rows = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in merkle.op7(spark, sf).collect())
    same(rows, brute(docs))
    assert all(r[5] > 0 for r in rows if r[1] >= 80)


@given(st.text(alphabet="ad. \n\t。x", max_size=90))
@settings(max_examples=300, deadline=None)
def test_parts_spell_the_text(text):
    assert "".join(x for s in tree(text) for p in s for x in p) == text
    for pattern in (merkle.SECTION, merkle.PARAGRAPH, merkle.LEAF):
        pattern = pattern.replace(r"\z", r"\Z")
        assert "".join(m[0] for m in re.finditer(pattern, text)) == text


def test_roots_are_equal_where_texts_are(spark):
    import itertools

    texts = ["".join(x) for n in range(6) for x in itertools.product("a\n ", repeat=n)] + ["Title\n\nBody.", "Title\n\n\n\nBody.", "Title\nBody.", "Title\n\nBody.\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", merkle.root(merkle.tree(F.col("x"))).alias("r")).collect()
    assert len({r.r for r in rows}) == len(set(texts)) == len(rows) and {r.x: r.r for r in rows} == {t: root(tree(t)) for t in texts}


def test_edits_are_located(spark):
    cases = [
        ("a\n\nb\nc", "a\n\nb\nd", (2, 2, 1)), ("a", "a", (None, None, None)), ("a", "a\n\nb", (1, 1, 1)), ("a\n\n", "a\n\nb", (2, 1, 1)), ("", "x", (1, 1, 1)),
        ("so. is and\n\nit is so. he ran and", "so. is and\n\nit is so. he runs and", (2, 1, 4)),
    ]
    df = spark.createDataFrame([(k, x, y) for k, (x, y, _) in enumerate(cases)], "k int, x string, y string")
    trees = df.select("k", merkle.tree(F.col("x")).alias("x"), merkle.tree(F.col("y")).alias("y"))
    got = merkle.differences(trees, "x", "y").orderBy("k").collect()
    assert [(r.edited_section, r.edited_paragraph, r.edited_leaf) for r in got] == [c[2] for c in cases]


def test_nothing_shared_is_not_alike(spark):
    got = {r[0]: r[6] for r in run(spark, [(1, "alpha\n"), (2, "beta\n"), (3, ""), (4, "")])}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_few_rows(spark):
    assert run(spark, [(1, "only. one")]) == brute([(1, "only. one")])
    df = spark.createDataFrame([(1, "x", "y", 2)], "doc_id long, text string, fingerprint string, next int")
    assert merkle.fingerprints(df).count() == 1 and merkle.fingerprints(df.limit(0)).count() == 0
