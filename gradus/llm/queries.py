"""The corpus queries of the registry."""

from __future__ import annotations

import corpus_pipeline

from . import op1_toxicity, op2_topk, op3_packing, op4_lines, op5_rans, op6_permutation, op7_jaccard, op8_html, op9_mixing, op10_secrets, op11_filters, op12_whitening, op13_language, oracles


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity.op1,
        "op2_topk": op2_topk.op2,
        "op3_packing": op3_packing.op3,
        "op4_lines": op4_lines.op4,
        "op5_rans": op5_rans.op5,
        "op6_permutation": op6_permutation.op6,
        "op7_jaccard": op7_jaccard.op7,
        "op8_html": op8_html.op8,
        "op9_mixing": op9_mixing.op9,
        "op10_secrets": op10_secrets.op10,
        "op11_filters": op11_filters.op11,
        "op12_whitening": op12_whitening.op12,
        "op13_language": op13_language.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
