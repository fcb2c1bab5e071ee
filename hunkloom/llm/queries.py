"""Queries of the training-data operators, and their DuckDB statements where SQL expresses them."""

from __future__ import annotations

from . import centroids, jaccard, language_id, line_dedup, lm_scoring, mixing, ogg, pieces, prefix_trie, quality, topk, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": language_id.op6_language_id,
    "op7_pieces": pieces.op7_pieces,
    "op8_ogg": ogg.op8_ogg,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_quality": quality.op10_quality,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_lm_score": lm_scoring.op12_lm_score,
    "op13_centroids": centroids.op13_centroids,
}
ORACLES = {"op1_line_dedup": line_dedup.OP1_SQL, "op2_source_mix": mixing.OP2_SQL, "op4_warc": warc.OP4_SQL, "op9_exact_topk": topk.OP9_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op13_centroids": centroids.OP13_SQL}
