"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, embeddings, fingerprint, license, lm, packing, pii, quality, simhash, wavelet

QUERIES = {
    "op1_packing": packing.query,
    "op2_quality": quality.query,
    "op3_simhash": simhash.query,
    "op4_fingerprints": fingerprint.query,
    "op5_pii": pii.query,
    "op6_embeddings": embeddings.query,
    "op7_wavelet": wavelet.query,
    "op8_bpe": bpe.query,
    "op9_lm": lm.query,
    "op10_license": license.query,
}
ORACLES: dict[str, str] = {
    "op4_fingerprints": fingerprint.ORACLE,
    "op6_embeddings": embeddings.ORACLE,
    "op10_license": license.ORACLE,
}
