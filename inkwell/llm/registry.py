"""The queries of this subpackage, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

from . import decontam, html, langid, mixing, neardup, oracles, pii, secrets, substring, vectors, warc

QUERIES = {
    "op1_warc_derivatives": warc.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_benchmark_decontamination": decontam.query,
    "op4_html_extraction": html.query,
    "op5_substring_dedup": substring.query,
    "op6_secret_scan": secrets.query,
    "op7_language_id": langid.query,
    "op8_source_mixing": mixing.query,
    "op9_personal_data": pii.query,
    "op10_embedding_near_dedup": vectors.query,
}

#: The others cannot be stated in SQL as a whole; tests/llm holds each against brute force.
ORACLES: dict[str, str] = oracles.ORACLES
