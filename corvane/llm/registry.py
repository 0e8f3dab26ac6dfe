"""Queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from corvane.llm import alignment, byte_quality, chat, decontamination, embeddings, lines, packing, scoring, simhash, simple8b, suffixes, toxicity, turns

QUERIES = {
    "op1_prefix_free_parsing": suffixes.query,
    "op3_positional_index": decontamination.query,
    "op4_prefix_tree": chat.query,
    "op5_line_spread": lines.query,
    "op7_cross_polytope": embeddings.query,
    "op8_masked_pseudo_likelihood": scoring.query,
    "op9_weak_supervision": toxicity.query,
    "op6_simhash_pivots": simhash.query,
    "op2_pack_powers_of_two": packing.query,
    "op10_simple8b": simple8b.query,
    "op11_lcp_trie": turns.query,
    "op12_token_alignment": alignment.query,
    "op13_byte_convolution": byte_quality.query,
}

#: Tokenizer ids cannot be had in SQL: op2, op10 and op12 are tested against the tokenizers library; classifiers on held-out rows.
ORACLES: dict[str, str] = {
    "op3_positional_index": decontamination.ORACLE,
    "op4_prefix_tree": chat.ORACLE,
    "op5_line_spread": lines.ORACLE,
    "op11_lcp_trie": turns.ORACLE,
}
