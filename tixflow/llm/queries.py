"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tixflow.llm.common import ship_package
from tixflow.llm.conversation_trie import op12_conversation_trie
from tixflow.llm.decontaminate import op9_decontamination
from tixflow.llm.fingerprints import op2_fingerprints
from tixflow.llm.line_dedup import op4_line_dedup
from tixflow.llm.lm_scoring import op10_lm_scoring
from tixflow.llm.minhash_dedup import op1_minhash_dedup
from tixflow.llm.oracle import ORACLE_SQL
from tixflow.llm.packing import op7_packing
from tixflow.llm.periodic_runs import op11_periodic_runs
from tixflow.llm.quality import op3_quality_classifier
from tixflow.llm.quality_rules import op13_quality_rules
from tixflow.llm.secrets import op6_secret_scans
from tixflow.llm.substring_dedup import op8_substring_dedup
from tixflow.llm.token_counts import op5_token_counts


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {q.__name__: _shipped(q) for q in (op1_minhash_dedup, op2_fingerprints, op3_quality_classifier, op4_line_dedup, op5_token_counts, op6_secret_scans,
                                              op7_packing, op8_substring_dedup, op9_decontamination, op10_lm_scoring, op11_periodic_runs, op12_conversation_trie, op13_quality_rules)}
__all__ = ["ORACLE_SQL", "QUERIES"]
