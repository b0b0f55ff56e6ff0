"""A corpus pipeline: language id, near-duplicate removal, removal of repeated passages, source mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import bpe, langid, mixing, neardup, substrings
from trackloom.llm.shared import cut, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text, or no letter in it); a missing `lang` is filled in."""
    return langid.recognised(docs, langid.fit(docs), "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id."""
    return neardup.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 13 words and more out of every document but the first that has them; n_chars follows."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws every document once or more, so that the sources' token shares come to the tempered weights."""
    return mixing.Mixer(docs).apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens): the ids of each drawn text as little-endian integers; each is decoded again and compared with its text."""
    import public_tokenizers

    return bpe.token_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=("lang", "source"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("tokens", tokens)]

#: Language id and byte-pair merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
