"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, langid, licences, merkle, mining, ogg, packing, pii, quality, secrets, simhash, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_ogg_media": ogg.query,
    "op3_secret_scan": secrets.query,
    "op4_pii": pii.query,
    "op5_language": langid.query,
    "op6_toxicity": toxicity.query,
    "op7_word_bpe": bpe.query,
    "op8_packing": packing.query,
    "op9_quality": quality.query,
    "op10_simhash": simhash.query,
    "op11_license_scan": licences.query,
    "op12_merkle_manifest": merkle.query,
    "op13_hard_negatives": mining.query,
}

ORACLES = {"op1_exact_dedup": exact_dedup.SQL, "op11_license_scan": licences.SQL, "op12_merkle_manifest": merkle.SQL, "op13_hard_negatives": mining.SQL}
