"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, filter_audit, hard_negatives, html_text, language_id, mixing, packing, parity_join, recurrent_lm, suffix_dedup, token_files, vp_search, warc

QUERIES = {
    "op1_vp_search": vp_search.op1,
    "op2_html_text": html_text.op2,
    "op3_parity_join": parity_join.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_pack": packing.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_mix_sources": mixing.op7,
    "op8_language_id": language_id.op8,
    "op9_warc": warc.op9,
    "op10_recurrent_lm": recurrent_lm.op10,
    "op11_token_files": token_files.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_hard_negatives": hard_negatives.op13,
}
ORACLE_SQL = {
    "op3_parity_join": parity_join.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
