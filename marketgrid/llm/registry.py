"""Queries of the training-data operators."""

from __future__ import annotations

from . import alignment, bpe, chat, jaccard_join, licenses, lsh_forest, merkle, packing, quality, secrets, site_style, substring_dedup, topk

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe,
        substring_dedup.op2_substring_dedup,
        site_style.op3_site_style_tree,
        chat.op4_quotation_linking,
        secrets.op5_secret_scan,
        topk.op6_exact_topk,
        jaccard_join.op7_jaccard_join,
        quality.op8_quality_rules,
        packing.op9_best_fit_packing,
        licenses.op10_license_scan,
        merkle.op11_merkle_manifest,
        lsh_forest.op12_lsh_forest,
        alignment.op13_tokenizer_alignment,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_exact_topk": topk.OP6_SQL, "op11_merkle_manifest": merkle.OP11_SQL}
