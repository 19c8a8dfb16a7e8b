"""Queries of the operators in this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from wayside.llm import chat, clusters, codes, fingerprints, html_text, language, minhash, mixing, packing, quality, secrets, toxicity, vectors

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_fingerprint": fingerprints.op4_fingerprint,
    "op5_near_vectors": vectors.op5_near_vectors,
    "op6_language": language.op6_language,
    "op7_near_documents": minhash.op7_near_documents,
    "op8_html_text": html_text.op8_html_text,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_chat": chat.op11_chat,
    "op12_clusters": clusters.op12_clusters,
    "op13_codes": codes.op13_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_secret_scan": secrets.oracle_sql(),
    "op5_near_vectors": vectors.oracle_sql(),
    "op11_chat": chat.oracle_sql(),
    "op12_clusters": clusters.oracle_sql(),
    "op13_codes": codes.oracle_sql(),
}
