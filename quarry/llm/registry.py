"""Queries of this subpackage by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_warc_chain": "warc",
    "op2_best_fit_packing": "packing",
    "op3_ngram_jaccard": "ngram_join",
    "op4_token_binary": "tokenfile",
    "op5_quality_ledger": "quality",
    "op6_feistel_pseudonyms": "pii",
    "op7_page_differencing": "html",
    "op8_stupid_backoff": "lm",
    "op9_quotation_linking": "chat",
    "op10_decontamination": "decontaminate",
}


def _query(module: str):
    def run(spark, sf_dir):
        return import_module(f"quarry.llm.{module}").query(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {name: _query(module) for name, module in _MODULES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quarry.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
