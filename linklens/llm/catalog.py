"""Queries of the numbered operators with their comparison SQL."""

from linklens.llm import op1_template_join, op2_bpe_chunks, op3_toxic_spans, op4_phrase_automata, op5_hamming_join, op6_exact_dedup, op7_role_repair, op8_pii_skip_chain, op9_license_blocks, op10_language_masks, op11_prefix_tokens, op12_audited_repair, op13_phrase_tries

MODULES = (op1_template_join, op2_bpe_chunks, op3_toxic_spans, op4_phrase_automata, op5_hamming_join, op6_exact_dedup, op7_role_repair, op8_pii_skip_chain, op9_license_blocks, op10_language_masks, op11_prefix_tokens, op12_audited_repair, op13_phrase_tries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
