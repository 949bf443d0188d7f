"""A cleaning pipeline over documents: each stage reads what the stage before it kept, written as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import bpe, decontam, jaccard, langid, suffix
from cipherlode.llm.text import lean_workers, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows know; those without letters go. lang becomes the prediction."""
    lean_workers(spark)
    learned = langid.samples(docs, "lang", "doc_id", "text", F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    out = langid.predict(docs.select(*COLUMNS), learned, keep=("text", "source", "n_chars"))
    return out.where(F.col("lang_pred") != langid.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id; of rows with that id, the first text. Rows without an id stay."""
    group = jaccard.clusters(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(group, "doc_id", "left_semi").select(*COLUMNS)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*").select(*COLUMNS)
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).union(first).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings, and the passages of over 50 words, that occur elsewhere too; documents of which nothing is left go. Rows without an id are rows as others."""
    rest = suffix.dedup(docs.select(F.struct("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text")).alias("row"), "text"), key="row", passage=suffix.PASSAGE)
    kept = rest.where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    text = F.when(~F.col("row.no_text"), F.col("kept"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A row is told by its id and its text, so null and repeated ids are judged by their own texts."""
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.withColumn("row", row)
    leaked = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row").select("row").distinct()
    return rows.join(leaked, "row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    out = bpe.tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language ID", language), ("n-gram Jaccard join", one_of_each), ("suffix-array dedup", repeats), ("benchmark decontamination", benchmark_free), ("byte-level BPE", encoded)]

#: The stages can't be put in SQL; tests hold each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
