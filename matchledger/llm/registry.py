"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, bpe, hmm, jpeg, langid, lines, near, packing, phrases, suffixes, topk, toxicity, urls

QUERIES = {
    "op1_lm_scoring": hmm.op1_lm_scoring,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_topk": topk.op4_topk,
    "op5_language_id": langid.op5_language_id,
    "op6_bpe": bpe.op6_bpe,
    "op7_suffix_array": suffixes.op7_suffix_array,
    "op8_progressive_jpeg": jpeg.op8_progressive_jpeg,
    "op9_minhash": near.op9_minhash,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_phrases": phrases.op11_phrases,
    "op12_alignment": align.op12_alignment,
    "op13_url_filters": urls.op13_url_filters,
}

ORACLE_SQL = {"op4_topk": topk.OP4_SQL, "op10_line_dedup": lines.OP10_SQL, "op11_phrases": phrases.OP11_SQL, "op13_url_filters": urls.OP13_SQL}
