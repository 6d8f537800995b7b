"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, covering, fingerprints, jaccard, media, mixing, packing, phrases, pii, quality, tokens, toxicity, urls


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_media": media.op5_media,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_pack": packing.op7_pack,
        "op8_url_filter": urls.op8_url_filter,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_pii": pii.op10_pii,
        "op11_collocations": phrases.op11_collocations,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_simhash_covering": covering.op13_simhash_covering,
        "op8_url_rules": urls.op8_url_rules,
        "op1_radius_search": fingerprints.op1_radius_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": jaccard.OP4_SQL, "op8_url_rules": urls.OP8_RULES_SQL, "op9_mix_sources": mixing.OP9_SQL, "op11_collocations": phrases.OP11_SQL, "op12_filter_audit": audit.OP12_SQL}
