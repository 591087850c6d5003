"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from . import decontaminate, divergence, exact_dedup, licenses, line_dedup, mixture, near_dedup, secrets, substring_dedup, surrogates, token_alignment, toxicity, warc

_MODULES = {
    "op1_decontaminate": decontaminate,
    "op2_jaccard_join": near_dedup,
    "op3_secrets": secrets,
    "op4_warc": warc,
    "op5_exact_dedup": exact_dedup,
    "op6_substring_dedup": substring_dedup,
    "op7_licenses": licenses,
    "op8_mixture": mixture,
    "op9_surrogates": surrogates,
    "op10_toxicity": toxicity,
    "op11_token_alignment": token_alignment,
    "op12_line_dedup": line_dedup,
    "op13_source_divergence": divergence,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
