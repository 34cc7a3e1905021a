"""Corpus pipeline: quality rules, near duplicates, benchmark passages, source
mix, token files. Each stage works on all that the one before it kept, read
from Parquet in the shared folder.

Edge cases are those of the operators; documents without an id pass the
near-duplicate stage (they are in no group), and a document whose row repeats
stays once there; rows of one id with different texts are judged each by its
text. A stage finds its input's columns by place, so further
columns of any name pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontaminate import decontaminate
from flowlens.llm.jaccard_join import jaccard_join, text_mark
from flowlens.llm.mixing import mix_sources
from flowlens.llm.quality import quality_rules
from flowlens.llm.queries import tokenizer_path
from flowlens.llm.token_files import token_files
from flowlens.session import read_table, write_scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = [f"c{k}" for k in range(len(docs.columns))]  # clear of the measures' names
    judged = quality_rules(docs.toDF(*own), text=own[docs.columns.index("text")], keep=tuple(own))
    return judged.where("kept").select(*(F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id (of its
    rows in the group the one with the smallest hash of the text)."""
    mark = "mark" + "_" * max(map(len, docs.columns))  # no column is called so
    classes = write_scratch(jaccard_join(docs, marks=True).withColumnRenamed("mark", mark), "classes")
    gone = classes.where("doc_id <> class_id").select("doc_id", mark).distinct()
    # rows of a class that share its smallest id; without a class, rows of equal text
    group = ["doc_id", "class_no", F.when(F.col("class_no").isNull(), F.col(mark)).alias("own")]
    again = classes.where("doc_id = class_id").groupBy(*group).agg(F.count("*").alias("n"), F.min(mark).alias("first")).where("n > 1")
    again = write_scratch(again, "again")
    # one plan at every size: the texts cross one shuffle, on id and hash
    key = ["doc_id", mark]
    left = docs.withColumn(mark, text_mark("text")).join(gone.hint("merge"), key, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    left = write_scratch(left, "left")
    more = (classes.where("doc_id = class_id").join(again.where("own is null").select("doc_id", "class_no", "first"), ["doc_id", "class_no"])
            .where(F.col(mark) != F.col("first")).select(*key).distinct())
    once = again.select("doc_id", F.col("first").alias(mark)).distinct()
    left = left.join(more, key, "left_anti")
    twice = left.join(once, key, "left_semi").dropDuplicates(key)
    return left.join(once, key, "left_anti").unionByName(twice).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    new = "_" * (1 + max(map(len, docs.columns)))  # no column ends so
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    thin = docs.select("doc_id", "text", key.alias("key"))
    hit = (decontaminate(thin, read_table(spark, sf_dir, "benchmark"), keep=("key",)).where("n_hit > 0")
           .select(F.col("doc_id").alias(f"id{new}"), F.col("key").alias(f"key{new}")).distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[f"id{new}"]) & (key == hit[f"key{new}"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reading of a document in the mix."""
    mark = "mix" + "_" * max(map(len, docs.columns))  # no column is called so
    return mix_sources(docs, mix=mark).drop(mark)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every reading, from token files."""
    return token_files(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: Token files can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), name.split(" ")[0])
    return STAGES[-1][1](spark, docs, sf_dir)
