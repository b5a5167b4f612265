"""The queries of this subpackage and their SQL."""

from . import bpe, code_compression, embedding_dedup, exact_dedup, katz, license_scan, mixing, ngram_join, piece_bpe, sharding, token_count, toxicity

QUERIES = {
    "op1_token_counts": token_count.query,
    "op2_mixing": mixing.query,
    "op3_license_scan": license_scan.query,
    "op4_byte_bpe": bpe.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_katz_scores": katz.query,
    "op7_ngram_join": ngram_join.query,
    "op8_toxicity": toxicity.query,
    "op9_hilbert_sharding": sharding.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_code_compression": code_compression.query,
    "op12_piece_bpe": piece_bpe.query,
}

ORACLES = {"op2_mixing": mixing.ORACLE, "op9_hilbert_sharding": sharding.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_code_compression": code_compression.ORACLE}
