"""The queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from . import crf, crosspoly, divergence, interactions, katz, ledger, lines, mil, minhash, mixing, oracles, rlbwt, tokens, wumanber

QUERIES = {
    "op1_katz": katz.query,
    "op2_skip_chain_crf": crf.query,
    "op3_blob_ledger": ledger.query,
    "op4_mix_sources": mixing.query,
    "op5_minhash_bottom_k": minhash.query,
    "op6_run_length_index": rlbwt.query,
    "op7_wu_manber": wumanber.query,
    "op8_token_output": tokens.query,
    "op9_gated_attention": mil.query,
    "op10_cross_polytope": crosspoly.query,
    "op11_line_labels": lines.query,
    "op12_filter_interactions": interactions.query,
    "op13_source_divergence": divergence.query,
}

ORACLES = {
    "op3_blob_ledger": ledger.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op5_minhash_bottom_k": oracles.NEAR,
    "op6_run_length_index": oracles.REPEATS,
    "op7_wu_manber": oracles.DECONTAMINATED,
    "op10_cross_polytope": oracles.VECTORS,
    "op12_filter_interactions": interactions.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
