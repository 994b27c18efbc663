"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from lattica.llm.class_lm import op10_class_lm
from lattica.llm.fingerprints import op9_fingerprints
from lattica.llm.host_rules import op4_host_rules
from lattica.llm.language_id import op2_language_id
from lattica.llm.mixing import op6_mixing
from lattica.llm.near_copies import op7_near_copies
from lattica.llm.pii import op5_pii
from lattica.llm.piece_encoding import op8_piece_encoding
from lattica.llm.rule_ensemble import op1_rule_ensemble
from lattica.llm.sql import SQL
from lattica.llm.token_counts import op3_token_counts

QUERIES = {f.__name__: f for f in (op1_rule_ensemble, op2_language_id, op3_token_counts, op4_host_rules, op5_pii, op6_mixing, op7_near_copies, op8_piece_encoding, op9_fingerprints, op10_class_lm)}

__all__ = ["QUERIES", "SQL"]
