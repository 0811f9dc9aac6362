"""Queries of this subpackage, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyspark.llm.best_fit import op12_best_fit
from tallyspark.llm.decontamination import OP7_SQL, op7_decontamination
from tallyspark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tallyspark.llm.language_id import op1_language_id
from tallyspark.llm.line_dedup import OP6_SQL, op6_line_dedup
from tallyspark.llm.lm_score import op3_lm_score
from tallyspark.llm.near_dup import OP2_SQL, op2_near_dup
from tallyspark.llm.packing import op9_packing
from tallyspark.llm.pii import op5_pii
from tallyspark.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tallyspark.llm.quality_fm import op8_quality_fm
from tallyspark.llm.quality_rules import op4_quality_rules
from tallyspark.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dup": op2_near_dup,
    "op3_lm_score": op3_lm_score,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_quality_fm": op8_quality_fm,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op2_near_dup": OP2_SQL, "op6_line_dedup": OP6_SQL, "op7_decontamination": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}
