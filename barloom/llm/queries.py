"""The registered queries `opN_<name>`: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import alignment, bpe, host_paths, jaccard, nbsvm, packing, quotes, repeats, risk_rules, rns, spann, suffix_tree, url_rules
from barloom.llm.common import remainder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_consensus_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(table(spark, sf_dir, "pages"))


@query
def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


@query
def op4_probabilistic_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query
def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_column(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = bpe.decode_column(ids, path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_association_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.mine(pages, table(spark, sf_dir, "labels"))).drop("mined")


@query
def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


@query
def op10_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op11_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.cut(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_residue_gemm_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rns.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query
def op13_arrow_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = alignment.align(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")
    aligned = written(aligned, "alignment", batch=512, codec="zstd")
    return alignment.with_counts(aligned, alignment.pair_counts(aligned, *paths), *paths).drop("links")
