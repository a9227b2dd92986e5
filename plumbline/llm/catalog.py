"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import bitcodes, codebooks, decontaminate, divergence, exact_dedup, langid, near_dedup, packing, pii, quality, secrets, sharding, warc

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_personal_data": pii.query,
    "op3_language_mixture": langid.query,
    "op4_sharding": sharding.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_secrets": secrets.query,
    "op7_decontamination": decontaminate.query,
    "op8_fixity_audit": warc.query,
    "op9_packing": packing.query,
    "op10_quality": quality.query,
    "op11_product_codes": codebooks.query,
    "op12_source_divergence": divergence.query,
    "op13_nearest_vectors": bitcodes.query,
}
SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_fixity_audit": warc.SQL,
    "op11_product_codes": codebooks.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_nearest_vectors": bitcodes.SQL,
}
