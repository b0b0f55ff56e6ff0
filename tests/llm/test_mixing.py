import re
from collections import Counter

import pytest

from trackloom.llm import mixing
from trackloom.llm.mixing import Mixer


def rows(spark, sizes, words=20):
    data, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            data.append((i, "w " * (words + i % 7), s))
            i += 1
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def test_bisection():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    x = mixing.exponent(sizes, 4.0, None)
    assert mixing.repetition(sizes, mixing.tempered(sizes, x), None) == pytest.approx(4.0)
    y = mixing.exponent(sizes, None, 0.8)
    assert mixing.entropy(mixing.tempered(sizes, y)) == pytest.approx(0.8)
    assert mixing.exponent(sizes, 1e9, None) == 0.0


def test_realised_shares(spark):
    df = rows(spark, {"big": 3000, "mid": 700, "small": 250})
    m = Mixer(df, repeats=2.5)
    got = m.schedule().collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    total = sum(tokens.values())
    for s, w in m.weights.items():
        assert abs(tokens[s] / total - w) < 0.005
    times = Counter(r.id for r in got)
    assert set(times) == set(range(3950)) and max(times.values()) <= 3  # every document, none beyond the limit rounded up
    of = {r.id: r.source for r in got}
    by = {s: {times[i] for i in times if of[i] == s} for s in m.weights}
    assert by["big"] == {1} and all(max(x) - min(x) <= 1 for x in by.values())
    again = Mixer(df, repeats=2.5).schedule().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sorted(r.doc_id for r in m.apply(df).collect()) == sorted(times.elements())
    places = Counter((r.source, r["pass"], r.block, r.place) for r in got)
    assert set(places.values()) == {1}


def test_given_budget_cuts(spark):
    df = rows(spark, {"a": 500, "b": 500})
    m = Mixer(df, budget=5000.0)
    got = m.schedule().collect()
    assert 4700 <= sum(r.tokens for r in got) <= 5000


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b", None, 1), (1, "a b", None, 1), (2, None, "x", 1), (None, "c", "y", 1), (4, "", "", 1)], "doc_id long, text string, source string, place int")
    out = Mixer(df).apply(df)
    assert out.columns == df.columns and {str(r.doc_id) for r in out.collect()} == {"1", "2", "None", "4"}
    assert Mixer(df.limit(0)).schedule().count() == 0


def test_tokens_of_any_script(spark):
    texts = ["plain words  here\n\ttoo", "caf\u00e9 na\u00efve \u0440\u0443\u0441", "\u4e2d\u6587 and words", "mix\u4e2d\u6587ed", "\u2019quoted\u2019 \u2014 dash", "\U0001f600 smile\U00020000s", "a\u00a0b\u3000c\x0b\x0c\x1cd",
             "\u0e44\u0e17\u0e22 x", "\u0dff\u0e00", "\ud55c\uad6d \uc5b4", " ", "", None]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.words("text").alias("t")).collect()}
    unspaced = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
    assert got == {i: len(re.findall(rf"[{unspaced}]|[^\x20\x09-\x0D{unspaced}]+", t or "")) for i, t in enumerate(texts)}
