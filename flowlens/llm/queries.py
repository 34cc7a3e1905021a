"""The registered queries: each operator with production parameters on its
whole table, digest columns derived from the operator's outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import read_table

from . import (
    decontaminate, divergence, host_reputation, jaccard_join, main_text, mixing, packing, quality, token_counts, token_files, toxicity, warc, whitening,
)

TOKENIZER = "byte_bpe_50k.json"
PACKING_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file lies; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes (url, bad): the quality label of the document that
    the number in the last part of a page's path names."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(host_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(\.html)?/?$", 1)
    named = pages.select("url", number.alias("n")).where("n <> ''").select("url", F.col("n").cast("long").alias("doc_id"))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return named.join(known, "doc_id").select("url", (1 - F.col("quality")).cast("int").alias("bad"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.host_reputation(read_table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_text(read_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reading of a document in the mix."""
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix.epoch", "mix.n_tokens", "mix.place")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "k")
    return packing.pack(digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_main_text, op4_decontamination, op5_jaccard_join,
                                    op6_source_mixing, op7_token_files, op8_warc_archive, op9_toxicity, op10_token_counts,
                                    op11_source_divergence, op12_embedding_whitening, op13_best_fit_packing)}
