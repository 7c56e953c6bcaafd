"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpusloom.llm import (
    bpe,
    collocations,
    decontaminate,
    fingerprint,
    html_text,
    interleave,
    merkle,
    minhash,
    pii,
    quotes,
    secret_scan,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_prefix_hash": fingerprint.op1_prefix_hash,
    "op2_template_leaks": decontaminate.op2_template_leaks,
    "op3_weak_supervision": pii.op3_weak_supervision,
    "op4_text_tag_ratio": html_text.op4_text_tag_ratio,
    "op5_quotation_links": quotes.op5_quotation_links,
    "op6_boosted_toxicity": toxicity.op6_boosted_toxicity,
    "op7_stratified_interleave": interleave.op7_stratified_interleave,
    "op8_rank_queue_bpe": bpe.op8_rank_queue_bpe,
    "op9_trigram_secrets": secret_scan.op9_trigram_secrets,
    "op10_hyperminhash": minhash.op10_hyperminhash,
    "op11_hat_trie": collocations.op11_hat_trie,
    "op12_sibling_shift": merkle.op12_sibling_shift,
    "op13_hash_prefix_rules": url_filter.op13_hash_prefix_rules,
}

ORACLES = {
    "op7_stratified_interleave": interleave.SQL,
    "op10_hyperminhash": minhash.SQL,
    "op11_hat_trie": collocations.SQL,
    "op12_sibling_shift": merkle.SQL,
    "op13_hash_prefix_rules": url_filter.SQL,
}
