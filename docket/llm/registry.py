"""Queries of the corpus operators and the SQL that states the same, where SQL can."""

from __future__ import annotations

from . import ann, chat, decontaminate, langid, mixing, resample, sharding, simhash, substring, suffix, toxicity, trie, urlfilter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_simhash": simhash.op2_simhash,
    "op3_ann": ann.op3_ann,
    "op4_substring": substring.op4_substring,
    "op5_suffix_array": suffix.op5_suffix_array,
    "op6_url_filters": urlfilter.op6_url_filters,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_chat": chat.op10_chat,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_resample": resample.op13_resample,
}
ORACLES = {
    "op4_substring": substring.SQL,
    "op5_suffix_array": suffix.SQL,
    "op6_url_filters": urlfilter.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op10_chat": chat.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_resample": resample.SQL,
}
