"""Registry of the subpackage: query callables and, where SQL can express them, oracle SQL."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .line_dedup import op8_line_dedup
from .mixing import op9_mixing
from .near_dup import op2_near_duplicates, oracle_sql as op2_sql
from .pieces import op4_sentencepiece
from .quality_model import op1_quality_classifier
from .quality_rules import OP5_SQL, op5_quality_rules
from .sharding import op7_sharding
from .substrings import OP12_SQL, op12_substring_dedup
from .topk import OP10_SQL, op10_topk
from .warc import op6_warc_derivatives

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
}

ORACLE_SQL = {
    "op2_near_duplicates": op2_sql(),
    "op3_chat_formatting": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op10_topk": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
}
