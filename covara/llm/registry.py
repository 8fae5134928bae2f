"""Queries of the subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import ORACLE_SQL as TRIE_SQL
from .conversations import op12_prefix_trie
from .decontaminate import op1_decontaminate
from .interpolation import op4_lm_score
from .langid import op5_language_id
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import op11_merkle_manifest
from .mixing import op7_mix_sources
from .quality import op3_quality_rules
from .secrets import op8_secret_scan
from .simhash import op9_simhash
from .suffixes import op10_suffix_dedup
from .toxicity import op6_toxicity
from .urls import ORACLE_SQL as URLS_SQL
from .urls import op13_url_filter
from .wrappers import op2_html_text

_OPERATORS = (op1_decontaminate, op2_html_text, op3_quality_rules, op4_lm_score, op5_language_id, op6_toxicity, op7_mix_sources, op8_secret_scan, op9_simhash, op10_suffix_dedup, op11_merkle_manifest, op12_prefix_trie, op13_url_filter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": MERKLE_SQL, "op12_prefix_trie": TRIE_SQL, "op13_url_filter": URLS_SQL}
