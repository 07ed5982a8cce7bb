"""Marking: votes, absence, citations, rubric totals and scoring against bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote(votes: DataFrame, check: str, met: str, sample: str, unanimous: bool) -> DataFrame:
    """Tri-state vote by check: yes or no with enough voices, else null (deferred)."""
    n = F.count("*")
    need = n if unanimous else F.floor(n / 2) + 1
    yes, no = F.count_if(F.col(met)), F.count_if(~F.col(met))
    return votes.groupBy(check).agg(
        F.when(yes >= need, True).when(no >= need, False).alias("verdict"), yes.alias("yes"), no.alias("no"), F.sort_array(F.collect_set(F.when(F.col(met), F.col(sample)))).alias("cited")
    )


def absent_status(plausible: Column, satisfied: Column, pages_missing: Column, much_unassigned: Column) -> Column:
    """Precedence of the reasons for an absent answer."""
    return F.when(plausible, "uncertain").when(satisfied, "not_required").when(pages_missing, "pages_missing").when(much_unassigned, "uncertain").otherwise("unanswered")


def citation_problems(cited: DataFrame, found: str, outside: Column, over: Column) -> DataFrame:
    """Rows with a problem: line not found, outside the answer, or awarded too much; the first counts."""
    problem = F.when(F.col(found).isNull(), "invented").when(outside, "out_of_scope").when(over, "over_awarded")
    return cited.withColumn("problem", problem).where("problem is not null")


def scoring(facts: DataFrame, keys: list[str], zero_below: float) -> DataFrame:
    """n, in_band, false_zero, false_credit and mean_error of awarded marks against low..high."""
    a, low, high = F.col("awarded"), F.col("low"), F.col("high")
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(a.between(low, high)).alias("in_band"),
        F.count_if((a < zero_below) & (low > 0)).alias("false_zero"),
        F.count_if(a > high).alias("false_credit"),
        F.round(F.avg(F.abs(a - (low + high) / 2)), 2).alias("mean_error"),
    )


def anchor_status(resolved: Column, ambiguous: Column, outscored: Column, in_order: Column, confirmed: Column) -> Column:
    """What a written label is worth."""
    return (
        F.when(~resolved, F.when(ambiguous, "unverified").otherwise("disputed"))
        .when(outscored & ~in_order, "disputed")
        .when(confirmed, "confirmed")
        .when(in_order, "confirmed")
        .otherwise("unverified")
    )


def assemble_checks(judged: DataFrame) -> DataFrame:
    """Grades from binary checks.

    judged: sub_id, qid, marks, met (tri-state), error, unverifiable, cited (array), known (array of valid line
    ids). Met is full marks if a citation is valid; unverifiable and not refused is credited; not met with a
    stated error is zero; all else is deferred at zero.
    """
    valid = F.size(F.array_intersect("cited", "known")) > 0
    credited = (F.col("unverifiable") & (F.col("met").isNull() | F.col("met"))) | (F.coalesce("met", F.lit(False)) & valid)
    refused = ~F.coalesce("met", F.lit(True)) & (F.length(F.coalesce("error", F.lit(""))) > 0)
    rows = judged.withColumn("credited", credited).withColumn("deferred", ~credited & ~refused)
    return rows.groupBy("sub_id", "qid").agg(
        F.sum(F.when(F.col("credited"), F.col("marks")).otherwise(0.0)).alias("awarded"), F.sum("marks").alias("available"), F.bool_or("deferred").alias("needs_review"), F.count_if("deferred").alias("n_deferred")
    )


def assemble_points(judged: DataFrame) -> DataFrame:
    """Grades from scalar judgements.

    judged: sub_id, qid, criterion (marks), given, satisfied, cited, known. Marks are clamped to the criterion,
    satisfied points earn all of it, uncited credit is zero, and one invalid citation refuses the question.
    """
    clamped = F.least(F.greatest("given", F.lit(0.0)), F.col("criterion"))
    full = F.when(F.col("satisfied"), F.col("criterion")).otherwise(clamped)
    marks = F.when(F.size("cited") == 0, 0.0).otherwise(full)
    bad = F.size(F.array_except("cited", "known")) > 0
    return judged.groupBy("sub_id", "qid").agg(
        F.when(F.bool_or(bad), 0.0).otherwise(F.sum(marks)).alias("awarded"), F.sum("criterion").alias("available"), (~F.bool_or(bad)).alias("judged")
    )
