"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import functools

from . import bpe, chat_format, decontamination, infilling, line_dedup, line_rules, packing, resampling, set_join, substring_dedup, token_rollup, token_store, toxicity
from .common import small_batches


def _bounded(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def queries():
    return {k: _bounded(f) for k, f in _QUERIES.items()}


_QUERIES = {
    "op1_line_frequency": line_rules.op1_line_frequency,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_store": token_store.op3_token_store,
    "op4_token_rollup": token_rollup.op4_token_rollup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_set_join": set_join.op10_set_join,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_bpe": bpe.op12_bpe,
    "op13_fill_in_middle": infilling.op13_fill_in_middle,
}


def oracle_sql():
    return {
        "op1_line_frequency": line_rules.ORACLE,
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op4_token_rollup": token_rollup.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op10_set_join": set_join.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
        "op13_fill_in_middle": infilling.ORACLE,
    }
