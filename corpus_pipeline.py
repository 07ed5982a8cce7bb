"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, PII and SentencePiece pieces.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; its output
is written as Parquet and read again as the next stage's docs. All stages but the last return the columns
of documents, in their order, whatever other columns there are.

Defined results: an empty table passes through every stage empty; null and empty texts are clean, are linked with
nothing, hold no benchmark item and have no pieces; rows without doc_id are filtered like others, by their text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import decontaminate, jaccard, pieces, surrogates, toxicity
from docspan.llm.text import cut, delete, free_name, scratch, shared_dir
from docspan.operators.runs import spread

BROADCAST_IDS = 1_000_000  # row hashes that may be broadcast; beyond it the join shuffles


def _where_in(docs: DataFrame, column: str, values: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose column is (left_semi) or is not (left_anti) among the values, a table of one column v."""
    name = free_name(docs, "v")
    values = values.withColumnRenamed("v", name)
    if values.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        values = F.broadcast(values)
    return docs.join(values, F.col(column) == F.col(name), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as label 1 go; null and empty texts are clean."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, one row stays: that of the smallest doc_id.

    Rows of one doc_id that are linked, or repeated, are a group like any other; a row without doc_id stays only where
    its group has no other. Null, empty and blank texts are linked with nothing and all stay.
    """
    row = free_name(docs, "row_hash")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    groups = cut(jaccard.jaccard_components(docs)).where("class_id is not null")
    rows = cut(groups.groupBy("class_id", "row_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row_hash").alias("hash"), "n"))
    heads = cut(rows.groupBy("class_id").agg(head.alias("head")).select("head.hash", "head.n"))
    kept = _where_in(keyed, row, cut(rows.select(F.col("row_hash").alias("v")).join(heads, F.col("v") == F.col("hash"), "left_anti")), "left_anti")
    repeated = heads.where("n > 1").select(F.col("hash").alias("v"))
    if repeated.limit(1).count():
        kept = _where_in(kept, row, repeated, "left_anti").unionByName(_where_in(kept, row, repeated, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the rows of one doc_id are one document."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates under the session's secret; n_chars follows the new text, null texts stay null."""
    replaced = surrogates.replace_pii(docs, surrogates.secret_key(spark)).select(docs.columns)
    return replaced.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the pieces of its text (none for a null or empty one); repeated rows each give a row."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("sentencepiece", encode_pieces),
]

# Learnt scores, similarity components, keyed surrogates and piece encodings have no SQL form; tests hold the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage's output is written to the shared folder and read again.

    The tables that a stage needs on its way, and the output of the stage before, go once its own output is written.
    """
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        out = f"{place}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if i:
            delete(spark, f"{place}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(out)
    return docs
