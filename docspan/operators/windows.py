"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


def global_rank(rows: DataFrame, by: str, order: Column, *ties: str) -> DataFrame:
    """rows with place: the row number in the order of a Column that falls or rises with the column by, then ties.

    Quantiles of the order cut the rows into at most BUCKETS ranges; a row's place is its number inside its range
    behind the sizes of the ranges before, so ranges are ranked side by side. Equal values share a range.
    """
    keyed = rows.withColumn("rank_value", order)
    cuts = sorted(set(keyed.approxQuantile("rank_value", [i / BUCKETS for i in range(1, BUCKETS)], 0.005)))
    ranged = keyed.withColumn("rank_range", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("rank_value"))))
    sizes = ranged.groupBy("rank_range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("rank_range").alias("r"), F.coalesce(F.sum("n").over(Window.orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"))
    number = F.row_number().over(Window.partitionBy("rank_range").orderBy("rank_value", *ties))
    placed = ranged.withColumn("number", number).join(F.broadcast(before), F.col("rank_range") == F.col("r"))  # BUCKETS rows
    return placed.withColumn("place", (F.col("rank_before") + F.col("number")).cast("long")).select(*rows.columns, "place")
