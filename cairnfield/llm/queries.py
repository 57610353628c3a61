"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard_join, language, line_dedup, quality, sharding, suffix_dedup, topk, toxicity, trie, whitening

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_exact_topk": topk.query,
    "op3_decontamination": decontaminate.query,
    "op4_byte_bpe": bpe.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_language_id": language.query,
    "op9_line_dedup": line_dedup.query,
    "op10_quality": quality.query,
    "op11_chat_format": chat.query,
    "op12_whitening": whitening.query,
    "op13_prefix_trie": trie.query,
}

ORACLES = {
    "op2_exact_topk": topk.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op11_chat_format": chat.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
