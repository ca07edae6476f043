"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, language_id, lexical_search, mixing, quality_ranking, quality_rules, token_counts, token_files, toxicity, url_filter, whitening, word_codec

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_quality_rules": quality_rules.query,
    "op3_quality_ranking": quality_ranking.query,
    "op4_token_files": token_files.query,
    "op5_mixing": mixing.query,
    "op6_word_codec": word_codec.query,
    "op7_token_counts": token_counts.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_lexical_search": lexical_search.query,
    "op12_url_filter": url_filter.query,
    "op13_whitening": whitening.query,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
}
