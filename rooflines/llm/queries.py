"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import audit, decontaminate, jaccard, line_dedup, media, mixing, pii, secrets, sharding, toxicity, url_filter, warc, whitening


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_audio_features": media.op3_audio_features,
        "op4_poisson_mix": mixing.op4_poisson_mix,
        "op5_warc": warc.op5_warc,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_pii_pseudonyms": pii.op10_pii_pseudonyms,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_interleaved_shards": sharding.op12_interleaved_shards,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {**secrets.ORACLES, **line_dedup.ORACLES, **mixing.ORACLES, **warc.ORACLES, **url_filter.ORACLES, **decontaminate.ORACLES, **jaccard.ORACLES, **audit.ORACLES, **sharding.ORACLES}
