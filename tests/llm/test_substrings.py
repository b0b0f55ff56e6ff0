import hashlib
import random
import re

import numpy as np
import pytest

from trackloom.llm import substrings
from trackloom.llm.shared import Words


def brute(docs, window=13):
    """docs: (id, text) rows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, ws in split:
        gone = {k + d for k in range(len(ws) - window + 1) if least[tuple(ws[k : k + window])] < i for d in range(window)}
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, words=9):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(words)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 60))] for _ in range(5)] + [["a"] * 40]
    docs = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 6)):
            ws += rng.choice(passages)[rng.randint(0, 6) :] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        docs.append((i, " ".join(ws)))
    return docs


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, digest=True).collect())


def test_against_brute_force(spark):
    for seed, words in ((1, 3), (2, 9), (3, 500)):
        docs = corpus(seed, words=words)
        assert run(spark, docs) == brute(docs)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in substrings.documents(spark, sf).collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op9(spark, sf).collect())
    assert got == brute(docs) and sum(r[2] for r in got) > 0


def test_anchors_serve_several_windows():
    rng = random.Random(4)
    text = " ".join(str(rng.randint(0, 5000)) for _ in range(20000)).encode()
    at, *_ = substrings.anchors(Words([text]), 13)
    assert len(at) < 0.4 * 20000


def chosen(text, start, window=13):
    """What the window at `start` chose: places from its start, and hashes."""
    at, h, mask = substrings.anchors(Words([text.encode()]), window)
    return {(a - start, x) for a, x, m in zip(at.tolist(), h.tolist(), mask.tolist()) for d in range(6) if m >> d & 1 and a - substrings.BEFORE - d == start}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    for words in (2, 3, 6, 40, 1000):
        for _ in range(25):
            core = " ".join(str(rng.randint(0, words)) for _ in range(13))
            found = set()
            for _ in range(25):
                left, right = (" ".join(str(rng.randint(0, words)) for _ in range(rng.randint(0, 9))) for _ in range(2))
                found.add(frozenset(chosen(f"{left} {core} {right}", len(left.split()))))
            assert len(found) == 1 and min(map(len, found)) > 0


def test_edge_cases(spark):
    t = " ".join(f"x{k}" for k in range(20))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, t, "c"), (5, t, None), (5, t, None), (None, t, "d"), (None, None, None)], "doc_id long, text string, kept string")
    got = sorted((r[0] or 99, r[4], r[5]) for r in substrings.dedup(df).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 20, 0), (5, 20, 20), (5, 20, 20), (99, 0, 0), (99, 20, 20)]
    assert substrings.dedup(df.limit(0)).count() == 0 and substrings.dedup(df).columns == ["doc_id", "text", "kept_in", "kept", "n_words", "n_removed"]
    assert np.all([r[1] == t for r in df.where("doc_id = 3").collect()])


def test_wide_windows(spark):
    """More windows to an anchor than a mask has bits."""
    for window in (8, 39, 40, 75):
        docs = [(i, t) for i, t in corpus(7, words=9)] + [(100 + k, " ".join(f"z{j}" for j in range(k, k + 150))) for k in (0, 20, 50)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, window=window, digest=True).collect())
        assert got == brute(docs, window) and sum(r[2] for r in got) > 0


def test_words_that_polynomials_confuse(spark):
    t = [bin(k).count("1") & 1 for k in range(2048)]
    x, y = "".join("ab"[v] for v in t), "".join("ba"[v] for v in t)
    rest = [f"r{k}" for k in range(30)]
    docs = [(1, " ".join(rest[:6] + [x] + rest[6:14])), (2, " ".join(rest[:6] + [y] + rest[6:14])), (3, " ".join([x, y] * 12)), (4, " ".join([y, x] * 12)), (5, x)]
    assert run(spark, docs) == brute(docs)


def test_names_stand_for_words():
    """Stretches have one name if and only if they have the same words, and fewer symbols than words."""
    rng = random.Random(11)
    for words in (1, 2, 3, 8, 60, 3000):
        ws = [str(rng.randint(0, words)) for _ in range(3000)]
        w = Words([" ".join(ws).encode()])
        for width in (8, 13, 50):
            start = np.arange(len(ws) - width + 1)
            names, symbols = substrings.Levels(w, width).names(start, width)
            meant = [tuple(ws[i : i + width]) for i in start]
            assert len(set(zip(meant, names.tolist()))) == len(set(meant)) == len(set(names.tolist()))
            assert symbols.mean() < (0.9 if width == 8 else 0.8) * width


def test_long_repeats_share_high_symbols():
    """Two texts with one passage have its interior symbols in common at every level, and a symbol's expansion is its words."""
    rng = random.Random(12)
    passage, (one, two) = [f"p{rng.randint(0, 400)}" for _ in range(300)], ([f"{c}{k}" for k in range(90)] for c in "xy")
    w = Words([" ".join(one + passage + one).encode(), " ".join(two[:37] + passage).encode()])
    levels = substrings.Levels(w, 40).levels
    assert len(levels) >= 5
    for k, (name, begin, low, high, first, last) in enumerate(levels):
        inside = [{(int(b) - at, int(n)) for b, n, lo, hi in zip(begin, name, low, high) if lo >= at and hi <= at + 300} for at in (90, 480 + 37)]
        assert inside[0] == inside[1] and (k >= 4 or len(inside[0]) > 20)
        if k:
            assert (begin == levels[k - 1][1][first]).all() and (last >= first).all()
    assert len(levels[3][0]) < 0.6 * len(levels[0][0])


def test_frequent_names_stay_in_their_tasks():
    """A passage in every document sends a few rows to its own task, however many the documents are."""
    rng = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [f"{passage} {' '.join(str(rng.random()) for _ in range(9))}".encode() for _ in range(400)]
    ids = np.arange(400)
    rng.shuffle(ids)
    for later in (False, True):
        meeting, sent, sure = substrings.Meeting(later), 0, 0
        for i in range(0, 400, 50):
            w = Words(docs[i : i + 50])
            start = np.concatenate([np.arange(f, f + 20) for f in w.first])
            h, _ = substrings.Levels(w, 13).names(start, 13)
            row = w.doc[start]
            out = meeting.rows(row, h, start - w.first[row], ids[i : i + 50], np.zeros(50, np.int32), substrings.check_bits(w, start, 13)).to_pandas()
            sure += (out.tag < 0).sum()
            sent += (out.tag >= 0).sum()
        assert sure + sent >= 400 * 20 - (0 if later else 20) and sent <= 20 * 12


@pytest.mark.parametrize("seed", [21, 22])
def test_repeats_over_many_steps(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "steps", lambda column, most=0: ((k, min(k + 3, len(column))) for k in range(0, len(column), 3)))
    docs = corpus(seed, n=90)
    random.Random(seed).shuffle(docs)
    docs += [(7, docs[0][1]), (None, docs[1][1]), (None, docs[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, digest=True).collect())
    assert got == brute([(i if i is not None else 1 << 62, t) for i, t in docs])
