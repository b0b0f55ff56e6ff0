import re

import corpus_pipeline
from tests.llm import test_neardup, test_substrings
from trackloom.llm import bpe


def test_stages_against_brute_force(spark, sf):
    docs = bpe.documents(spark, sf).cache()
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "tokens"]
    one = corpus_pipeline.language_id(spark, docs, sf).cache()
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and set(kept) == {i for i, r in given.items() if r.text and any(c.isalpha() for c in r.text)}
    two = corpus_pipeline.near_dedup(spark, one, sf).cache()
    left = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == columns and set(left) == {i for i, _, _, first in test_neardup.brute(list(kept.items())) if first}
    three = corpus_pipeline.substring_dedup(spark, two, sf).cache()
    texts = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == columns and set(texts) == set(left)
    for i, n, removed, _ in test_substrings.brute(list(left.items())):
        assert len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) == n - removed and (removed or texts[i] == left[i])
    four = corpus_pipeline.mix_sources(spark, three, sf).cache()
    assert four.columns == columns and {r.doc_id for r in four.collect()} == set(texts) and four.count() > three.count()
    five = corpus_pipeline.tokens(spark, four, sf).collect()
    assert len(five) == four.count() and all(len(r.tokens) == 2 * r.n_tokens for r in five)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows_and_clashing_columns(spark, sf):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, "en", "a", 200), (2, long + " more", "en", None, 205), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "the only one here", None, "b", 17), (5, "12 !!", "en", "b", 5), (6, "x " * 30000, "en", "a", 60000), (7, "short one", "de", "a", 9), (7, "short one", "de", "a", 9)]
    names = ["kept", "id", "kind", "n", "src", "key", "c0", "tag", "at", "h", "n_tokens", "tokens", "pred", "score", "_gone", "copy", "turn", "place", "pass", "component_id"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns or name == "tokens"
    left = sorted(str(r.doc_id) for r in docs.collect())
    assert set(left) == {"1", "None", "6", "7"}


def test_empty_documents(spark, sf):
    docs = bpe.documents(spark, sf).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
