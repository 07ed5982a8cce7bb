"""Sources: documents as bytes, recognised pages as JSON, golden samples, mark sets, line-role snapshots and TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan import schema

#: Limits of an upload, and what counts as an image.
MAX_BYTES, MAX_PAGES = 40 * 1024 * 1024, 60
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def is_image_upload(filename: Column) -> Column:
    return F.lower(F.substring_index(filename, ".", -1)).isin(*IMAGE_SUFFIXES)


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """content_hash, filename, kind, byte_size, page_count, problem of uploaded files.

    Pages of a PDF are counted by its page objects; a file with a problem is a row like any other.
    Spark's file sources leave out files without bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    pages = F.size(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"), F.lit(0)))
    image = is_image_upload(name)
    kind = F.when(image, "image").when(head == "%PDF-", "pdf").otherwise("unknown")
    count = F.when(image, 1).when(head == "%PDF-", pages).otherwise(0)
    problem = F.when(F.col("length") > MAX_BYTES, "too_large").when(kind == "unknown", "unsupported").when(count > MAX_PAGES, "too_many_pages")
    return files.select(F.sha2("content", 256).alias("content_hash"), name.alias("filename"), kind.alias("kind"), F.col("length").alias("byte_size"), count.alias("page_count"), problem.alias("problem"))


def read_recognised(spark: SparkSession, folder: str) -> DataFrame:
    """LINE rows of recognition responses (one JSON document a page) with their words in order.

    page_key, line_id, text, confidence (0 to 1), x0, y0, x1, y1, words.
    """
    raw = spark.read.schema(schema.BLOCKS_JSON).option("multiLine", "true").json(folder).select(F.input_file_name().alias("page_key"), F.explode("Blocks").alias("b"))
    lines = raw.where("b.BlockType = 'LINE'")
    words = raw.where("b.BlockType = 'WORD'").select(F.col("page_key").alias("w_page"), F.col("b.Id").alias("w_id"), F.col("b.Text").alias("word"))
    children = lines.select("page_key", F.col("b.Id").alias("line_id"), F.explode_outer(F.filter("b.Relationships", lambda r: r["Type"] == "CHILD")).alias("r")).select("page_key", "line_id", F.posexplode_outer("r.Ids").alias("pos", "id"))
    joined = children.join(words, (F.col("page_key") == F.col("w_page")) & (F.col("id") == F.col("w_id")), "left")
    grouped = joined.groupBy("page_key", "line_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda w: w["word"]).alias("words"))
    box = F.col("b.Geometry.BoundingBox")
    flat = lines.select(
        "page_key", F.col("b.Id").alias("line_id"), F.col("b.Text").alias("text"), (F.col("b.Confidence") / 100).alias("confidence"),
        box["Left"].alias("x0"), box["Top"].alias("y0"), (box["Left"] + box["Width"]).alias("x1"), (box["Top"] + box["Height"]).alias("y1"),
    )
    return flat.join(grouped, ["page_key", "line_id"], "left")


def read_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Golden samples: one truth.json a directory."""
    return spark.read.schema(schema.GOLDEN).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "truth.json").json(folder)


def golden_from(reader, folder: str) -> DataFrame:
    """Samples that write_golden wrote, one a line."""
    return reader.schema(schema.GOLDEN).json(folder)


def write_golden(samples: DataFrame, folder: str) -> None:
    samples.write.mode("overwrite").json(folder)


def read_mark_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Mark sets as read; where the totals of the band are missing they are the sums of the questions' bands."""
    sets = spark.read.schema(schema.MARK_SET).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    total = lambda c: F.aggregate("questions", F.lit(0.0), lambda s, q: s + F.coalesce(q[c], F.lit(0.0)))
    return sets.withColumn("total_low", F.coalesce("total_low", total("band_low"))).withColumn("total_high", F.coalesce("total_high", total("band_high")))


def marks_from_golden(golden: DataFrame) -> DataFrame:
    """The other shape of a mark set: truth questions joined with their answers by qid, with defaults."""
    q = golden.select("sample_id", F.explode("questions").alias("q")).select("sample_id", "q.qid", "q.label_raw", F.col("q.marks").cast("double").alias("marks_available"))
    a = golden.select("sample_id", F.explode("answers").alias("a")).select("sample_id", "a.qid", "a.status")
    return q.join(a, ["sample_id", "qid"], "left").withColumn("status", F.coalesce("status", F.lit("unanswered")))


def mark_set_problems(sets: DataFrame) -> DataFrame:
    """doc_id, qid, problem: awarded above available or outside its band, unanswered with marks, null marks without a reason."""
    q = sets.select("doc_id", F.explode("questions").alias("q")).select("doc_id", "q.*")
    a = F.col("marks_awarded")
    problems = F.array(
        F.when(a > F.col("marks_available"), "above_available"), F.when((a < F.col("band_low")) | (a > F.col("band_high")), "outside_band"),
        F.when((F.col("status") == "unanswered") & (a > 0), "unanswered_with_marks"), F.when(a.isNull() != F.col("excluded_reason").isNotNull(), "null_without_reason"),
    )
    return q.select("doc_id", "qid", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def read_role_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """paper, ord, role, text of line-role snapshots (role, tab, text a line). A paper is read whole, so its order is its own."""
    whole = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("paper"), "value")
    rows = whole.select("paper", F.posexplode(F.split("value", "\n")).alias("ord", "line")).where("line <> ''")
    return rows.select("paper", (F.col("ord") + 1).cast("long").alias("ord"), F.substring_index("line", "\t", 1).alias("role"), F.expr("substr(line, instr(line, '\t') + 1)").alias("text"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """stem, prompt, text of a tab-separated transcription list: comments and rows of fewer than five fields are left out."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(fields.alias("f")).where(F.size("f") >= 5)
    return rows.select(F.regexp_replace(F.col("f")[0], r"\.[^.]*$", "").alias("stem"), F.col("f")[2].alias("prompt"), F.col("f")[4].alias("text"))
