"""The queries of this folder and the SQL that some of them must agree with."""

from __future__ import annotations

from . import decontam, html, langid, minhash, mixing, quality, sharding, sketches, tokens, urls


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            minhash.op1_minhash_dedup, quality.op2_quality_classifier, html.op3_html_extraction, langid.op4_language_id,
            decontam.op5_decontamination, urls.op6_url_filter, sharding.op7_consistent_sharding,
            tokens.op8_token_counts, mixing.op9_source_mix, sketches.op10_fingerprints,
            # views of these that SQL can follow
            urls.url_rules, sharding.shard_laws, mixing.mix_targets, sketches.edited_texts,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash.OP1_SQL, "op3_html_extraction": html.OP3_SQL, "op5_decontamination": decontam.OP5_SQL,
        "url_rules": urls.URL_RULES_SQL, "shard_laws": sharding.SHARD_LAWS_SQL, "mix_targets": mixing.MIX_TARGETS_SQL, "edited_texts": sketches.EDITED_TEXTS_SQL,
    }
