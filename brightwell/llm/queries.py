"""The registered queries of this subpackage: each applies its operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm import block_ann, bpe, bpe_table, cutting_stock, exact_dedup, lexical_nra, ordinal_toxicity, quality_rules, residual_packing, secret_index, simhash_ball, spelling_fst, substring_cms, warc_index
from brightwell.sources import read_table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return bpe.vocabulary(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_index.warc_round_trip(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.simhash_components(read_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary()
    found = bpe_table.bpe_decode(bpe_table.bpe_encode(read_table(spark, sf_dir, "documents"), vocab), vocab)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.secret_spans(read_table(spark, sf_dir, "documents"))
    counts = [secret_index.span_count(F.col("spans"), n).alias(f"n_{r.kind}") for n, r in enumerate(secret_index.BASE_RULES)]
    listed = secret_index.span_list(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_cms.substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_nra.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_fst.group_variants(read_table(spark, sf_dir, "documents"))


def op13_cutting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(read_table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_simhash, op4_bpe, op5_toxicity, op6_exact_dedup, op7_nearest, op8_secrets, op9_packing, op10_substrings, op11_search, op12_variants, op13_cutting)}
