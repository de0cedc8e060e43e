"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import OP11_SQL, op11_conversation_trie
from .html_text import op2_html_text
from .line_dedup import op5_line_dedup
from .media import op7_wav_fingerprints
from .mixing import OP6_SQL, op6_mixing
from .near_duplicates import op9_near_duplicates
from .packing import op3_packing
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .posting_lists import op13_posting_lists
from .quality_model import op10_quality_model
from .quality_rules import op4_quality_rules
from .token_files import op1_token_files
from .warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_files, op2_html_text, op3_packing, op4_quality_rules, op5_line_dedup, op6_mixing, op7_wav_fingerprints, op8_warc, op9_near_duplicates, op10_quality_model, op11_conversation_trie, op12_periodic_runs, op13_posting_lists)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op11_conversation_trie": OP11_SQL, "op12_periodic_runs": OP12_SQL}
