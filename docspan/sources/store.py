"""Sinks: a versioned document store, a content index, a bank cache and a page store, on plain Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.sources.place import new_folder

PAGE_KEY = r"^[0-9a-f]{16}/p[0-9]{4}\.png$"
STALE_MINUTES = 20


class VersionedStore:
    """Documents with optimistic versions: a save is an append of the rows whose expected version is the latest.

    Saves are batches; of several rows with one key in a batch the one that sorts first is taken. Concurrent
    writers need an external lock or table format, as for any plain Parquet folder.
    """

    SCHEMA = "key string, version long, updated_at timestamp, body string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.history().limit(0).write.mode("append").parquet(folder)

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except Exception as error:  # the folder does not exist yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def latest(self) -> DataFrame:
        newest = F.max_by(F.struct("version", "updated_at", "body"), "version").alias("r")
        return self.history().groupBy("key").agg(newest).select("key", "r.*")

    def save(self, rows: DataFrame) -> DataFrame:
        """rows: key, expect_version (0 for a new key), updated_at, body. Returns the rejected rows, from a table of their own."""
        one = rows.groupBy("key").agg(F.min(F.struct("expect_version", "updated_at", "body")).alias("r")).select("key", "r.*")
        current = self.latest().select("key", F.col("version").alias("current"))
        place = new_folder(self.spark, "save")
        one.join(current, "key", "left").withColumn("current", F.coalesce("current", F.lit(0).cast("long"))).write.parquet(place)
        checked = self.spark.read.parquet(place)
        checked.where("expect_version = current").select("key", (F.col("current") + 1).alias("version"), "updated_at", "body").write.mode("append").parquet(self.folder)
        return checked.where("expect_version <> current").select("key", "expect_version", "current")


def settle(documents: DataFrame, now: str) -> DataFrame:
    """Pending and processing documents without news for twenty minutes have failed."""
    old = F.col("updated_at") < F.expr(f"timestamp'{now}' - interval {STALE_MINUTES} minutes")
    return documents.withColumn("status", F.when(F.col("status").isin("pending", "processing") & old, "failed").otherwise(F.col("status")))


def first_writers(contents: DataFrame) -> DataFrame:
    """content_hash, sub_id: the first submission of each content, by seq."""
    return contents.groupBy("content_hash").agg(F.min_by("sub_id", F.struct("seq", "sub_id")).alias("sub_id"))


def with_banks(questions: DataFrame, banks: DataFrame, key: F.Column) -> DataFrame:
    """Questions with their cached check bank; a miss is null."""
    return questions.withColumn("bank_key", F.substring(F.sha2(key, 256), 1, 32)).join(banks.select("bank_key", "bank"), "bank_key", "left")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Page images by key, in folders by hash prefix; keys that do not have the form are refused."""
    bad = pages.where(~F.col("image_key").rlike(PAGE_KEY)).limit(1).count()
    if bad:
        raise ValueError("a page key must be <16 hex digits>/pNNNN.png")
    pages.withColumn("hash_prefix", F.substring("image_key", 1, 2)).write.mode("append").partitionBy("hash_prefix").parquet(folder)


def missing_pages(wanted: DataFrame, stored: DataFrame, *by: str) -> DataFrame:
    """Pages that still have to be rendered; by names the columns that tell apart pages whose keys may clash."""
    keys = ["image_key", *by]
    return wanted.join(stored.select(*keys), keys, "left_anti")
