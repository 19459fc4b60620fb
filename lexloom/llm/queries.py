"""Queries of this subpackage: one for each numbered operator, with production parameters, over whole tables."""

from . import centroids, exactdedup, fingerprint, jaccard, mixing, packing, quality, scoring, spelling, tokens, topk, toxicity, warc
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprint(spark, sf_dir):
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_mixing_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "tie")


def op5_jaccard_join(spark, sf_dir):
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_scoring(spark, sf_dir):
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op11_exact_owners(spark, sf_dir):
    return exactdedup.exact_owners(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("scanned")


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_toxicity, op3_packing, op4_mixing_sources, op5_jaccard_join, op6_warc, op7_quality, op8_exact_top_k, op9_scoring, op10_token_counts, op11_exact_owners, op12_spelling_variants, op13_centroid_clusters)}
ORACLES = {"op4_mixing_sources": mixing.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op8_exact_top_k": topk.ORACLE_SQL, "op11_exact_owners": exactdedup.ORACLE_SQL, "op13_centroid_clusters": centroids.ORACLE_SQL}
