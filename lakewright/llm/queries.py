"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from lakewright.llm import chat, decontaminate, embed_dedup, langid, minhash, mixing, pii, secrets, toxicity, url_filter

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_chat_format": chat.query,
    "op3_url_filter": url_filter.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": langid.query,
    "op6_pii_surrogates": pii.query,
    "op7_embedding_dedup": embed_dedup.query,
    "op8_decontamination": decontaminate.query,
    "op9_secret_scan": secrets.query,
    "op10_minhash_dedup": minhash.query,
}

ORACLES = {
    "op1_source_mix": mixing.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op7_embedding_dedup": embed_dedup.ORACLE,
    "op10_minhash_dedup": minhash.ORACLE,
}
