"""The queries of this subpackage by name, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import alignment, audit, chat, embeddings, licenses, minhash, mixing, packing, passages, quality, recurrent, substring, tokencount

QUERIES = {
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "mix_overlapping_sources": mixing.mix_overlapping_sources,
    "op5_pack_documents": packing.op5_pack_documents,
    "op9_license_scan": licenses.op9_license_scan,
    "op1_chat_format": chat.op1_chat_format,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_token_counts": tokencount.op8_token_counts,
    "op10_language_model": recurrent.op10_language_model,
    "op2_quality_rules": quality.op2_quality_rules,
    "op11_quality_classifier": passages.op11_quality_classifier,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_align_tokenizers": alignment.op13_align_tokenizers,
}
ORACLE_SQL = {
    "op4_minhash_near_dedup": minhash.OP4_SQL,
    "op6_substring_dedup": substring.OP6_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op7_embedding_near_dedup": embeddings.OP7_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
