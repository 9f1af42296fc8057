"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

import corpus_pipeline
from meridian.llm import alignment, bpe, jaccard_join, langid, lattice, lm_score, mixing, quality_knn, quality_rules, secret_scan, sharding, url_filter, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_knn": quality_knn.op4_quality_knn,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_mixing": mixing.op6_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": langid.op8_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_lattice_dedup": lattice.op10_lattice_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_alignment": alignment.op12_alignment,
    "op13_sharding": sharding.op13_sharding,
}
ORACLE_SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_lm_score": lm_score.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_lattice_dedup": lattice.OP10_SQL,
}
