"""Catalogue of the training-data queries: name -> callable, and the DuckDB text where SQL can express the result."""

from __future__ import annotations

from riskflow.llm.filter_audit import OP12_SQL, op12_filter_audit
from riskflow.llm.fingerprints import op3_fingerprints
from riskflow.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from riskflow.llm.jaccard_join import op9_jaccard_join
from riskflow.llm.lm_score import op2_lm_score
from riskflow.llm.mixing import op1_mix_sources
from riskflow.llm.packing import op10_pack_harmonic
from riskflow.llm.pii import op13_pii_anchors
from riskflow.llm.quality import op7_quality_rules
from riskflow.llm.secrets import op6_secret_scan
from riskflow.llm.suffix_dedup import op4_suffix_dedup
from riskflow.llm.toxicity import op8_toxicity
from riskflow.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_lm_score, op3_fingerprints, op4_suffix_dedup, op5_url_filter, op6_secret_scan, op7_quality_rules,
    op8_toxicity, op9_jaccard_join, op10_pack_harmonic, op11_hard_negatives, op12_filter_audit, op13_pii_anchors)}

# The other results need 64-bit hashes, sketches, tokenizers or learned scores; tests compare them with brute force.
ORACLES = {"op5_url_filter": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL}
