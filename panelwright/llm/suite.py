"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from panelwright.llm import bloomlm, fingerprints, language, licenses, merkle, mixing, neardup, packing, spelling, topk, toxicity, urls, warc

QUERIES = {
    "op1_license_scan": licenses.op1,
    "op2_warc_archive": warc.op2,
    "op3_source_mixing": mixing.op3,
    "op4_hierarchical_packing": packing.op4,
    "op5_exact_top_k": topk.op5,
    "op6_language_model": bloomlm.op6,
    "op7_near_duplicates": neardup.op7,
    "op8_language_id": language.op8,
    "op9_toxicity": toxicity.op9,
    "op10_document_fingerprints": fingerprints.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_url_filter": urls.op12,
    "op13_spelling_variants": spelling.op13,
}

SQL = {
    "op2_warc_archive": warc.SQL,
    "op3_source_mixing": mixing.SQL,
    "op5_exact_top_k": topk.SQL,
    "op10_document_fingerprints": fingerprints.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_url_filter": urls.SQL,
    "op13_spelling_variants": spelling.SQL,
}
