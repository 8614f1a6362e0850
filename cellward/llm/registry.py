"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from cellward.llm import chat, imatch, language, lattice, mixing, negatives, packing, periodic, pii, scoring, simhash, tokens, urls

QUERIES = {
    f.__name__: f
    for f in (
        language.op1_language_id,
        tokens.op2_token_counts,
        chat.op3_chat_formatting,
        imatch.op4_imatch_fingerprints,
        lattice.op5_lattice_near_dedup,
        mixing.op6_mix_sources,
        simhash.op7_simhash_near_dedup,
        urls.op8_url_filters,
        pii.op9_personal_data,
        packing.op10_curve_packing,
        negatives.op11_hard_negatives,
        periodic.op12_periodic_runs,
        scoring.op13_context_mixing,
    )
}
SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op8_url_filters": urls.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
