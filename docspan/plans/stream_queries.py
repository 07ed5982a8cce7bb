"""Queries that run a stream over the events until it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.plans.catalogue import Catalogue
from docspan.plans.group_queries import CATALOGUE as GROUPS
from docspan.streaming import progress

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, max(event_id) as last_id from events group by 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.daily_counts(progress.read_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("""with g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, cast(min(ts) as varchar) as start, count(*) as n from s group by user_id, k having max(ts) + interval 30 minute <= (select max(ts) from events) - interval 1 day""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of thirty minutes that the watermark of one day has closed."""
    s = progress.sessions(progress.read_events(spark, sf_dir), "30 minutes")
    text = F.regexp_replace(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return s.select("user_id", F.when(F.date_format("start", "SSSSSS") == "000000", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).otherwise(text).alias("start"), "n")


@query(GROUPS.oracles["limiter_admission"])
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.admission(progress.read_events(spark, sf_dir), limit=3, seconds=864_000)


@query("select event_id, user_id, event_type, event_type = 'error' as terminal from events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress log as a stream has appended it."""
    return progress.progress_log(progress.read_events(spark, sf_dir))


@query("with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events), t as (select user_id, min(seq) as last from e where event_type = 'error' group by 1) select e.user_id, e.event_id, seq, seq = coalesce(last, -1) as closes from e left join t using (user_id) where seq <= coalesce(last, seq)")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener gets of each log: every event in order, up to the first terminal one."""
    rows = progress.progress_log(progress.read_events(spark, sf_dir)).join(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = rows.withColumn("seq", F.row_number().over(w).cast("long"))
    last = F.min(F.when(F.col("terminal"), F.col("seq"))).over(Window.partitionBy("user_id"))
    return e.withColumn("last", last).where("seq <= coalesce(last, seq)").select("user_id", "event_id", "seq", (F.col("seq") == F.coalesce("last", F.lit(-1))).alias("closes"))
