import random
import zlib

import numpy as np

from trackloom.llm import langid


def longest_phrases(text, strings):
    """Cross-parsing as it is defined, in blocks."""
    total = 0
    for b in range(0, len(text), langid.BLOCK):
        block, at, n = text[b : b + langid.BLOCK], 0, 0
        while at < len(block):
            k = 1
            while at + k <= len(block) and any(block[at : at + k] in s for s in strings):
                k += 1
            at += max(1, k - 1)
            n += 1
        total += n
    return total


def test_phrases_against_brute_force():
    rng = random.Random(3)
    samples = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(6)] for x, letters in (("p", "abc "), ("q", "abd"))}
    model = langid.Model(samples)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 700))).strip() or "a" for _ in range(40)]
    plain = [langid.normalised(t) for t in texts]
    strings = {k: [langid.normalised(x) for x in v] for k, v in samples.items()}
    for text in plain:
        p = langid.points(text)
        got = model.phrases(model.classes[p], np.array([len(p)]))[0]
        for name, n in zip(model.names, got.tolist()):
            assert n == longest_phrases(text, strings[name]), (text, name)


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in langid.documents(spark, sf).collect()}
    rows = langid.op1(spark, sf).collect()
    assert len(rows) == len(truth)
    mine = [r for r in rows if r.held_out]
    assert {r.doc_id for r in mine} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in mine) >= 0.97 * len(mine)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    long = "der die das und nicht " * 3000
    df = spark.createDataFrame(
        [(1, "the cat and the dog of the house", "en", 0.5), (2, "der hund und die katze in dem haus", "de", 0.5), (3, None, "de", None), (4, "", None, 1.0), (5, "123 !!", "en", None), (None, "the house", None, None), (6, long, None, None), (7, "Ωμέγα", None, None), (8, "𝒳", None, None)],
        "doc_id long, text string, lang string, score double",
    )
    model = langid.fit(df)
    got = {r.id: r for r in langid.identify(df, model).collect()}
    assert (got[3].lang_pred, got[4].lang_pred, got[5].lang_pred) == ("und",) * 3 and got[3].score == 0
    assert got[None].lang_pred == "en" and got[6].lang_pred == "de" and got[7].lang_pred in ("en", "de") and got[8].lang_pred in ("en", "de")
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_long_texts_are_learned(spark):
    """A language whose labelled texts are all long is learned, each text from several of its places."""
    en, de, fr = ("the cat and the dog of the house ", "der hund und die katze in dem haus ", "le chat et le chien de la maison ")
    rows = [(k, en, "en") for k in range(20)] + [(k, de * 200, "de") for k in range(20, 40)] + [(k, fr * 3000, "fr") for k in range(40, 42)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert sorted(model.names) == ["de", "en", "fr"]
    assert {(r.id, r.lang_pred) for r in langid.identify(df, model).collect()} == {(k, x) for k, _, x in rows}


def test_recognised_drops_only_letterless(spark):
    df = spark.createDataFrame([(1, "the house", None), (2, None, "en"), (3, "12 !", "en"), (4, "Ωμέγα " * 900, None)], "doc_id long, text string, lang string")
    for model in (langid.fit(df), langid.Model({})):
        assert {(r.doc_id, r.lang) for r in langid.recognised(df, model, "lang").collect()} == {(1, "und"), (4, "und")}


def test_every_letter_is_learned(spark):
    """Scripts of thousands of letters, and one beyond the basic plane, by the counts of phrases."""
    rng = random.Random(5)
    scripts = {"zh": range(0x4E00, 0x5200), "ja": range(0x5200, 0x5600), "ko": range(0xAC00, 0xB000), "ff": range(0x1E900, 0x1E944)}
    text = {k: ["".join(chr(rng.choice(v)) for _ in range(1200)) for _ in range(10)] for k, v in scripts.items()} | {"en": ["the cat and the dog of the house " * 30] * 10}
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in text.items() for t in v)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    for k, v in text.items():
        # pieces of the texts read in another order
        assert model.predict(["".join(v[3][i : i + 40] for i in range(1000, -1, -40))])[0] == [k]
    some = langid.normalised(text["zh"][0][:300] + " the ሀ " + text["ff"][0][:300])
    p = langid.points(some)
    strings = {k: [langid.normalised(x) for x in v] for k, v in text.items()}
    got = model.phrases(model.classes[p], np.array([len(p)]))[0]
    assert dict(zip(model.names, got.tolist())) == {k: longest_phrases(some, v) for k, v in strings.items()}


def test_every_label_is_learned(spark):
    """More labels than have the full sample each; those with the fewest documents too."""
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouwxyz"][:80]
    rows = [(len(words) * j + k, f"{w}{w} {w} " * 20, f"l{k:02}") for k, w in enumerate(words) for j in range(2 if k < 64 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.names) == 80
    assert {(r.id, r.lang_pred) for r in langid.identify(df, model).collect()} == {(k, x) for k, _, x in rows}
