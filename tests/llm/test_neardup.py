import random
import re

from trackloom.llm import neardup


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(a), find(i), find(i) == i) for i, a in sets)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    docs, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 14)):
            ws = list(base)
            for _ in range(rng.randint(0, 5)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            docs.append((i, " ".join(ws)))
            base = ws if rng.random() < 0.3 else base  # chains: the ends need not be near
            i += 1
    docs += [(i, "one two"), (i + 1, "One TWO"), (i + 2, "one"), (i + 3, ""), (i + 4, "")]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got, want = run(spark, docs), brute(docs)
        assert got == want
        assert len({r[2] for r in got}) < len(got)


def test_long_chains(spark):
    ws = [f"v{k}" for k in range(100 + 30 * 4)]
    docs = [(1000 - k, " ".join(ws[4 * k : 4 * k + 100])) for k in range(30)]
    assert run(spark, docs) == brute(docs)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in neardup.documents(spark, sf).collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op5(spark, sf).collect()) == brute(docs)


def test_edge_cases(spark):
    t = " ".join(f"x{k}" for k in range(20))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, t, 0), (5, t.upper(), None), (5, t.upper(), 1), (None, t, 2), (None, None, 3)], "doc_id long, text string, kind int")
    got = sorted(((r.id or 99, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 16, 3, True), (5, 16, 3, False), (5, 16, 3, False), (99, 0, None, True), (99, 16, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None", "None"]


def thue_morse(n):
    """Two words that hash alike under any polynomial modulo 2**64."""
    t = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(4096)
    rest = " ".join(f"r{k}" for k in range(9))
    docs = [(1, x), (2, y), (3, f"{x} {rest}"), (4, f"{y} {rest} {x}"), (5, x[:1024]), (6, y[:1024])]
    got = run(spark, docs)
    assert got == brute(docs) and len({r[2] for r in got}) == 6


def test_an_id_repeated_with_other_texts(spark):
    ws = [f"n{k}" for k in range(60)]
    x, near, other = " ".join(ws), " ".join(ws[:-1] + ["z"]), " ".join(f"o{k}" for k in range(40))
    for docs in ([(1, x), (5, near), (5, other)], [(3, x), (5, x), (5, other), (7, other)]):
        assert {r[2] for r in run(spark, docs)} == {docs[0][0]}


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.8 that share nothing else: every one is found, and none below."""
    rng, docs, want = random.Random(9), [], set()
    for k in range(1200):
        ws = [f"p{k}x{j}" for j in range(64)]
        cut = rng.randint(10, 17)  # the shingles of the first 64 - cut words are shared
        docs += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ws[: 64 - cut] + [f"q{k}x{j}" for j in range(rng.choice([0, 1, 2]))]))]
        a, b = shingles(docs[-1][1]), shingles(docs[-2][1])
        if 100 * len(a & b) >= 75 * len(a | b):
            want.add(2 * k + 1)
    got = {i for i, _, _, kept in run(spark, docs) if not kept}
    assert got == want and 300 < len(want) < 1200


def test_large_groups_are_compared_in_squares(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 3)
    docs = corpus(5)
    assert run(spark, docs) == brute(docs)
