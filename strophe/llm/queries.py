"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, exact_dedup, langid, media, mixing, near_dedup, packing, rans, sharding, suffix_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_pfair_mixing": mixing.op1_pfair_mixing,
    "op2_chroma_fingerprints": media.op2_chroma_fingerprints,
    "op3_rans_tokens": rans.op3_rans_tokens,
    "op4_digest_array": url_filter.op4_digest_array,
    "op5_bounded_ring": sharding.op5_bounded_ring,
    "op6_setsketch": near_dedup.op6_setsketch,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_levels": suffix_dedup.op9_suffix_levels,
    "op10_language_fusion": langid.op10_language_fusion,
    "op11_factorization_machine": toxicity.op11_factorization_machine,
    "op12_polarisation_whitening": whitening.op12_polarisation_whitening,
    "op13_equal_average_clusters": centroids.op13_equal_average_clusters,
    "pages_language_fusion": langid.pages_language_fusion,
}
ORACLES = {"op4_digest_array": url_filter.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op13_equal_average_clusters": centroids.OP13_SQL}
