"""Queries and SQL of the operators in this subpackage, by name."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of a session and a folder) and SQL (name -> DuckDB text).
MODULES = ("langid", "bpe", "topk", "toxicity", "neardup", "sharding", "merkle", "urls", "substrings", "mixing")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"trackloom.llm.{name}"), what)
    return found


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return _all("QUERIES") | {"pipeline": _pipeline}


def oracle_sql() -> dict:
    return _all("SQL")
