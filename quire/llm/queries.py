"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from quire.llm import ann, bpe, decontaminate, html, language, licenses, lm, merkle, neardup, quality, topk, trie, urls

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_url_filter": urls.op2_url_filter,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_main_text": html.op5_main_text,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_suffix_tree": lm.op7_suffix_tree,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_language": language.op9_language,
    "op10_quality": quality.op10_quality,
    "op11_adaptive_scan": ann.op11_adaptive_scan,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_top_k": topk.OP1_SQL,
    "op2_url_filter": urls.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
