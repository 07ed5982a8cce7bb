"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Index. A test item has n distinct shingles, ordered by hash. Items are partitioned by size into classes of a
factor of two; all items of a class show signatures of one length, u - ceil(t * u) + 1 smallest hashes for the
largest size u of the class (all of them, if an item has fewer). A document that holds the share t of an item
lacks at most n - ceil(t * n) of its shingles, so it holds one of the signature and none is missed.

Search. The shingle hashes of the documents, of any length, stream past the signatures only; what meets one is
a candidate pair. Verification. The shingles of candidate documents meet the whole shingle sets of the items,
compared as text, and pairs that hold the share t stay.

Defined results: null, empty and blank texts match nothing; an item or document of fewer than k words
is one shingle of all its words; rows of one doc_id are one document, while repeated items each give
their own rows; a null item_id or doc_id is kept as a key; empty tables give no rows; ties (several items in
one document) each give a row; very long texts are searched whole. Other columns are ignored, whatever their
names, and without_contaminated passes all of them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import cut, free_name

SHINGLE = 5
CONTAINMENT = 0.8
BROADCAST_SHINGLES = 500_000  # signature or index rows (about 100 bytes each) that may be broadcast; beyond it the join shuffles
BROADCAST_IDS = 1_000_000  # document ids that may be broadcast

_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), _SPACE)


def _places(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k-word slices of the words column, one a row."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(1)))).alias("at")
    return df.select(*keys, "words", at).select(*keys, F.slice("words", F.col("at"), k).alias("part"))


def _hash(part: Column) -> Column:
    return F.xxhash64(part)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_index(benchmark: DataFrame, k: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """item_id, row, n, size_class, shingle, h, signed: the shingle is in the item's signature."""
    items = benchmark.where("text is not null").select("item_id", F.monotonically_increasing_id().alias("row"), words("text").alias("words"))
    rows = _places(items, k, "item_id", "row").select("item_id", "row", F.array_join("part", " ").alias("shingle"), _hash(F.col("part")).alias("h"))
    rows = cut(rows.where("shingle <> ''").distinct())
    sized = rows.groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("hashes"))
    sized = sized.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    lengths = sized.groupBy("size_class").agg(F.max("n").alias("u")).select("size_class", (F.col("u") - F.ceil(F.col("u") * t - 1e-9) + 1).alias("length"))
    last = F.element_at("hashes", F.least("length", "n").cast("int"))
    signed = sized.join(lengths, "size_class").select("row", "n", "size_class", last.alias("last"))
    return rows.join(signed, "row").select("item_id", "row", "n", "size_class", "shingle", "h", (F.col("h") <= F.col("last")).alias("signed"))


def candidates(docs: DataFrame, index: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc, row): documents that hold a shingle of an item's signature. docs: doc_id, words."""
    signatures = _small(index.where("signed").select("row", F.col("h").alias("item_h")), BROADCAST_SHINGLES)
    shown = _places(docs, k, "doc_id").select("doc_id", _hash(F.col("part")).alias("h"))
    return shown.join(signatures, F.col("h") == F.col("item_h")).select(F.col("doc_id").alias("doc"), "row").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_matched, containment, size_class of pairs at t or more."""
    index = cut(item_index(benchmark, k, t))
    texts = docs.where("text is not null").select("doc_id", words("text").alias("words"))
    found = cut(candidates(texts, index, k))
    held = _small(found.select("doc").distinct(), BROADCAST_IDS)
    rows = _places(texts.join(held, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi"), k, "doc_id")
    rows = rows.select("doc_id", _hash(F.col("part")).alias("h"), F.array_join("part", " ").alias("shingle"))
    whole = _small(index.select("row", F.col("h").alias("item_h"), F.col("shingle").alias("item_shingle")), BROADCAST_SHINGLES)
    met = rows.join(whole, (F.col("h") == F.col("item_h")) & (F.col("shingle") == F.col("item_shingle")))
    pairs = met.groupBy("doc_id", "row", "shingle").agg(F.lit(1).alias("one")).groupBy("doc_id", "row").agg(F.count("*").alias("n_matched"))
    pairs = pairs.join(found.withColumnRenamed("row", "r"), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("r")), "left_semi")
    items = _small(index.select(F.col("row").alias("r"), "item_id", "n", "size_class").distinct(), BROADCAST_SHINGLES)
    return pairs.join(items, F.col("row") == F.col("r")).where(F.col("n_matched") >= F.ceil(F.col("n") * t - 1e-9)).select(
        "doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_matched", F.round(F.col("n_matched") / F.col("n"), 6).alias("containment"), "size_class"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no benchmark item, all columns (the rows without doc_id count as one document)."""
    gone = free_name(docs, "found_id")
    found = cut(contaminated(docs.select("doc_id", "text"), benchmark, k, t).select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(_small(found, BROADCAST_IDS), docs["doc_id"].eqNullSafe(found[gone]), "left_anti")


ORACLE = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents where text is not null
), iw as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark where text is not null
), ds as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) as s from w where len(ws) > 0
), bs as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) as s from iw where len(ws) > 0
), n as (select item_id, count(*) as n from bs group by 1),
m as (select doc_id, item_id, count(*) as n_matched from ds join bs using (s) group by 1, 2)
select doc_id, item_id, n as n_item_shingles, n_matched, round(n_matched / n, 6) as containment, cast(floor(log2(n)) as integer) as size_class
from m join n using (item_id) where n_matched >= ceil(n * 0.8 - 1e-9)
"""
