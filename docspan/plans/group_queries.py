"""Grouping, windows, hierarchy, set operations, marking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.functions import patterns as P
from docspan.functions import text as X
from docspan.operators import folds, marking
from docspan.operators import windows as W
from docspan.plans import views as V
from docspan.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
T = V.table


def dsum(c: str) -> F.Column:
    """A sum of doubles that does not depend on their order: exact to the cent."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""
select o_orderstatus as status, cast(sum(case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end::decimal(18,2)) as double) as final,
  cast(sum(o_totalprice::decimal(18,2)) as double) as proposed, cast(sum(case when o_orderkey % 7 = 0 then 1 else 0 end) as bigint) as corrected, count(*) as available from orders group by 1""")
def grade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with the teacher's override in front of the proposal."""
    o = T(spark, sf_dir, "orders").withColumn("override", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1)).withColumn("final", F.coalesce("override", "o_totalprice"))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(dsum("final").alias("final"), dsum("o_totalprice").alias("proposed"), F.count("override").alias("corrected"), F.count("*").alias("available"))


@query(V.with_(V.SUB_LINES, body="""
, u as (select l_orderkey, sum(case when ord % 3 = 0 then 1 else 0 end) as unmarked, count(*) as n from sub_lines group by 1),
p as (select o_orderkey, cast(floor(o_totalprice / 1000) as bigint) as rate from orders)
select l_orderkey, ord, case when ord % 3 <> 0 then 2 when (rate - 2 * (n - unmarked)) % unmarked = 0 and rate > 2 * (n - unmarked) then cast((rate - 2 * (n - unmarked)) // unmarked as bigint) end as marks
from sub_lines join u using (l_orderkey) join p on l_orderkey = o_orderkey"""))
def section_residual_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a printed section total leaves, shared over the parts without marks if it divides."""
    w = Window.partitionBy("l_orderkey")
    s = V.sub_lines(spark, sf_dir).select("l_orderkey", "ord")
    s = s.withColumn("unmarked", F.count_if(F.col("ord") % 3 == 0).over(w)).withColumn("n", F.count("*").over(w))
    rate = T(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("rate"))
    left = F.col("rate") - 2 * (F.col("n") - F.col("unmarked"))
    share = F.when((left > 0) & (F.try_mod(left, "unmarked") == 0), F.expr("try_divide(rate - 2 * (n - unmarked), unmarked)").cast("long"))
    return s.join(rate, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "ord", F.when(F.col("ord") % 3 != 0, F.lit(2).cast("long")).otherwise(share).alias("marks"))


_PATHS = "paths as (select c_custkey, cast(r_regionkey as varchar) || '/' || cast(n_nationkey as varchar) as parent, n_nationkey, r_regionkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T(spark, sf_dir, "nation").join(T(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = T(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat_ws("/", F.col("r_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("parent"), "n_nationkey", "r_regionkey")


@query("""select n_nationkey, r_regionkey, count(c_custkey) as descendants, count(c_custkey) > 0 as is_stem
from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2""")
def stems_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the number of their descendants; those that have any are stems."""
    per = T(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("d"))
    n = T(spark, sf_dir, "nation").join(T(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    d = F.coalesce("d", F.lit(0))
    return n.select("n_nationkey", "r_regionkey", d.cast("long").alias("descendants"), (d > 0).alias("is_stem"))


@query(f"""with {_PATHS}, a as (select distinct o_custkey from orders), s as (select parent, count(*) as answered from paths join a on c_custkey = o_custkey group by 1)
select c_custkey, coalesce(answered, 0) - case when o_custkey is null then 0 else 1 end > 0 as sibling_answered from paths left join s using (parent) left join a on c_custkey = o_custkey""")
def sibling_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another child of the same parent was answered: counts by parent, less oneself."""
    paths = _paths(spark, sf_dir).join(T(spark, sf_dir, "orders").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left")
    per = paths.groupBy("parent").agg(F.count("o_custkey").alias("answered"))
    return paths.join(per, "parent").select("c_custkey", (F.col("answered") - F.when(F.col("o_custkey").isNull(), 0).otherwise(1) > 0).alias("sibling_answered"))


@query("""with g as (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders)
select o_custkey, o_orderkey + 1 as first_missing, nxt - 1 as last_missing, nxt - o_orderkey - 1 as n_missing from g where nxt > o_orderkey + 1""")
def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap between consecutive siblings: the first and the last missing number, and how many there are."""
    g = T(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("nxt"))
    return g.where("nxt > o_orderkey + 1").selectExpr("o_custkey", "o_orderkey + 1 as first_missing", "nxt - 1 as last_missing", "nxt - o_orderkey - 1 as n_missing")


@query("select o_orderpriority as section, count(*) filter (where o_orderstatus = 'F') as answered, count(*) filter (where o_orderstatus = 'F') >= 100 as satisfied from orders group by 1")
def sections_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = F.count_if(F.col("o_orderstatus") == "F")
    return T(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("section")).agg(answered.alias("answered"), (answered >= 100).alias("satisfied"))


@query("""
with l as (select l_orderkey, max(l_quantity) as best, count(*) as n from lineitem group by 1)
select o_orderkey, case when coalesce(best, 0) >= 45 then 'uncertain' when o_orderpriority like '1%' then 'not_required' when o_orderstatus = 'P' then 'pages_missing' when coalesce(n, 0) >= 7 then 'uncertain' else 'unanswered' end as status
from orders left join l on o_orderkey = l_orderkey""")
def absence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a question has no answer: plausible elsewhere, quota met, pages missing, much ink unassigned, else unanswered."""
    l = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("best"), F.count("*").alias("n"))  # noqa: E741
    o = T(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = marking.absent_status(F.coalesce("best", F.lit(0)) >= 45, F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "P", F.coalesce("n", F.lit(0)) >= 7)
    return o.select("o_orderkey", status.alias("status"))


_CONT = "(" + " or ".join(f"contains(lower(text), '{m}')" for m in P.CONTINUATION_MARKERS) + ")"


@query(f"select conv_id, max(turn) as last_turn, arg_max({_CONT}, turn) or max(turn) < 3 as pages_missing from conversations group by 1")
def pages_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation seems cut off if its last turn goes on elsewhere or comes before turn 3."""
    return T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), (F.max_by(X.mentions_continuation(F.col("text")), "turn") | (F.max("turn") < 3)).alias("pages_missing"))


def _vote(need: str) -> str:
    return V.with_(V.VOTES, body=f"""
select check_id, case when count(*) filter (where met) >= {need} then true when count(*) filter (where not met) >= {need} then false end as verdict,
  count(*) filter (where met) as yes, count(*) filter (where not met) as no, array_to_string(coalesce(list_sort(list(distinct sample) filter (where met)), []), ',') as cited from votes group by 1""")


@query(_vote("(count(*) // 2 + 1)"))
def vote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority vote of yes, no and deferral; citations of the yes-voters."""
    return marking.vote(V.votes(spark, sf_dir), "check_id", "met", "sample", unanimous=False).withColumn("cited", F.array_join("cited", ","))


@query(_vote("count(*)"))
def vote_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marking.vote(V.votes(spark, sf_dir), "check_id", "met", "sample", unanimous=True).withColumn("cited", F.array_join("cited", ","))


@query(V.with_(V.VOTES, body="""
, t as (select check_id, sample, count(*) filter (where met) as total from votes group by 1, 2),
r as (select *, row_number() over (partition by check_id order by total, sample) as k, count(*) over (partition by check_id) as n from t)
select check_id, sample, total from r where k = n // 2 + 1"""))
def median_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample whose total is the upper median."""
    t = V.votes(spark, sf_dir).groupBy("check_id", "sample").agg(F.count_if("met").alias("total"))
    w = Window.partitionBy("check_id")
    r = t.withColumn("k", F.row_number().over(w.orderBy("total", "sample"))).withColumn("n", F.count("*").over(w))
    return r.where("k = n div 2 + 1").select("check_id", "sample", "total")


@query(V.with_(V.SUB_LINES, body="""
, w as (select l_orderkey, ord, l_partkey, row_number() over (partition by l_orderkey order by ord) as k from sub_lines where l_quantity < 25)
select l_orderkey, ord, l_partkey as topic from w where k <= 5"""))
def weak_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines of each order that earned less than half."""
    w = V.sub_lines(spark, sf_dir).where("l_quantity < 25").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ord")))
    return w.where("k <= 5").select("l_orderkey", "ord", F.col("l_partkey").alias("topic"))


@query(V.with_(V.SUB_LINES, body="""
, c as (select l_orderkey as cite_id, ord, l_orderkey + case when l_partkey % 11 = 0 then 100000000 else 0 end as cited, l_quantity as marks, l_partkey from sub_lines)
select cite_id, ord, case when o.o_orderkey is null then 'invented' when o.o_orderstatus = 'P' then 'out_of_scope' when marks > 49 then 'over_awarded' end as problem
from c left join orders o on cited = o.o_orderkey where o.o_orderkey is null or o.o_orderstatus = 'P' or marks > 49"""))
def citations_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of lines that do not exist, that lie outside the answer, or that earn more than there is."""
    c = V.sub_lines(spark, sf_dir).select(F.col("l_orderkey").alias("cite_id"), "ord", (F.col("l_orderkey") + F.when(F.col("l_partkey") % 11 == 0, 100000000).otherwise(0)).alias("cited"), F.col("l_quantity").alias("marks"))
    o = T(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return marking.citation_problems(c.join(o, F.col("cited") == F.col("o_orderkey"), "left"), "o_orderkey", F.col("o_orderstatus") == "P", F.col("marks") > 49).select("cite_id", "ord", "problem")


@query("""with s as (select conv_id, min(turn) filter (where role = 'user') as a, max(turn) filter (where role = 'assistant') as b from conversations group by 1)
select c.conv_id, c.turn, length(text) as chars from conversations c join s using (conv_id) where a is not null and b is not null and turn between least(a, b) and greatest(a, b)""")
def answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive span between two ordinals, either way round."""
    w = Window.partitionBy("conv_id")
    c = T(spark, sf_dir, "conversations").withColumn("a", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w)).withColumn("b", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    inside = F.col("turn").between(F.least("a", "b"), F.greatest("a", "b")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    return c.where(inside).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("select n.o_orderkey, coalesce(t.o_totalprice, n.o_totalprice + 1) as marks, t.o_orderkey is not null as kept from orders n left join (select * from orders where o_orderkey % 5 = 0) t using (o_orderkey)")
def teacher_override_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-marking keeps what the teacher decided."""
    new = T(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") + 1).alias("proposed"))
    old = T(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.col("o_totalprice").alias("teacher"))
    return new.join(old, "o_orderkey", "left").select("o_orderkey", F.coalesce("teacher", "proposed").alias("marks"), F.col("teacher").isNotNull().alias("kept"))


@query("""
with m as (select l_orderkey, list_sort(list(distinct l_partkey)) as blocks from lineitem group by 1)
select l_orderkey, array_to_string(case when l_orderkey % 2 = 0 then list_sort(list_distinct(list_concat(blocks, [1]))) else list_sort(list_filter(blocks, lambda x: x <> 1)) end, ',') as blocks,
  l_orderkey % 2 = 1 and len(list_filter(blocks, lambda x: x <> 1)) = 0 as now_uncertain from m""")
def reassign_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block 1 moves to the even questions; a question left without blocks becomes uncertain."""
    m = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("blocks"))
    one, even = F.array(F.lit(1).cast("long")), F.col("l_orderkey") % 2 == 0
    left = F.array_except("blocks", one)
    return m.select("l_orderkey", F.array_join(F.when(even, F.sort_array(F.array_union("blocks", one))).otherwise(left), ",").alias("blocks"), (~even & (F.size(left) == 0)).alias("now_uncertain"))


@query("select l.doc_id, coalesce(b.status, 'unanswered') as status, b.item_id from (select doc_id from labels) l left join (select item_id, item_id as doc_id, 'answered' as status from benchmark) b using (doc_id)")
def mapping_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for every question, unanswered where nothing maps to it."""
    b = T(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("doc_id"), F.lit("answered").alias("status"))
    return T(spark, sf_dir, "labels").select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("unanswered")).alias("status"), "item_id")


@query(V.with_(V.LINES, body="""
, f as (select doc_id, source, line, cast(round_even(ord / 10.0::double, 0) as bigint) as bucket from lines where length(line) > 0),
d as (select source, count(distinct doc_id) as docs from f group by 1)
select source, line, bucket, count(distinct doc_id) as n from f join d using (source) group by source, line, bucket, docs having count(distinct doc_id) >= greatest(3, cast(floor(0.1::double * docs) as bigint))"""))
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur at about the same place in at least a tenth of a source's documents, and in three."""
    f = V.lines(spark, sf_dir).where(F.length("line") > 0).select("doc_id", "source", "line", F.bround(F.col("ord") / 10.0, 0).cast("long").alias("bucket"))
    docs = f.select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("docs"))
    n = f.distinct().groupBy("source", "line", "bucket").agg(F.count("*").alias("n"))
    return n.join(docs, "source").where(F.col("n") >= F.greatest(F.lit(3), F.floor(0.1 * F.col("docs")))).select("source", "line", "bucket", "n")


@query("""
with p as (select p_partkey // 40 as paper_id, regexp_extract(p_brand || p_size, '^\\D*?(\\d)', 1) as letter, p_size as number from part)
select paper_id, letter, count(distinct number) as numbers from p group by 1, 2 having count(distinct number) >= 3""")
def section_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes that at least three different numbers follow."""
    p = T(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("paper_id"), F.regexp_extract(F.concat("p_brand", F.col("p_size").cast("string")), r"^\D*?(\d)", 1).alias("letter"), F.col("p_size").alias("number"))
    return p.distinct().groupBy("paper_id", "letter").agg(F.count("*").alias("numbers")).where("numbers >= 3")


@query("""
with g as (select user_id, event_id, epoch(ts) as t, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap from events),
s as (select user_id, 2.2 * greatest(coalesce(quantile_disc(gap, 0.5), 0), 60) as limit_ from g group by 1),
b as (select g.user_id, event_id, sum(case when gap is null or gap > limit_ then 1 else 0 end) over (partition by g.user_id order by t, event_id) as block from g join s using (user_id))
select user_id, cast(block as bigint) as block, count(*) as n, min(event_id) as first_id from b group by 1, 2""")
def blocks_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: a new block where the gap exceeds 2.2 times the usual one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    e = T(spark, sf_dir, "events").select("user_id", "event_id", "ts", t).withColumn("gap", F.col("t") - F.lag("t").over(w))
    usual = F.greatest(F.coalesce(F.expr("percentile_disc(0.5) within group (order by gap)").over(Window.partitionBy("user_id")), F.lit(0.0)), F.lit(60.0))
    e = e.withColumn("limit_", usual * 2.2)
    b = e.withColumn("block", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > F.col("limit_")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(V.with_(V.LINES, body="select doc_id, count(*) as n_lines, string_agg(line, ' ' order by ord) as text, count(distinct ord // 20) as pages from lines group by 1"))
def block_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's text in line order and the pages it covers."""
    return folds.build_blocks(V.lines(spark, sf_dir).withColumn("page", F.expr("ord div 20")), "doc_id", "ord", "line", "page")


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events)
select user_id, count(*) as replayed, max(seq) as cursor_, bool_or(event_type = 'error') as finished from e where seq > 3 group by 1""")
def progress_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a cursor, the new cursor, and whether a terminal event is among them."""
    e = T(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq")).where("seq > 3")
    return e.groupBy("user_id").agg(F.count("*").alias("replayed"), F.max("seq").alias("cursor_"), F.bool_or(F.col("event_type") == "error").alias("finished"))


@query("select event_id, case when ts < (select max(ts) from events) - interval 20 minute then 'failed' else 'processing' end as state from events where event_type in ('view', 'click')")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without news for twenty minutes count as failed; the latest time is a scalar subquery."""
    e = T(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).scalar()
    return e.where(F.col("event_type").isin("view", "click")).select("event_id", F.when(F.col("ts") < last - F.expr("interval 20 minutes"), "failed").otherwise("processing").alias("state"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as calls from events")
def sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the same key in the trailing hour."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return T(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("calls"))


@query("""
with recursive o as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (
  select user_id, k, event_id, true as allowed, [t] as calls from o where k = 1
  union all
  select o.user_id, o.k, o.event_id, len(list_filter(r.calls, lambda c: c > o.t - 864000000000)) < 3,
    case when len(list_filter(r.calls, lambda c: c > o.t - 864000000000)) < 3 then list_concat(list_filter(r.calls, lambda c: c > o.t - 864000000000), [o.t]) else list_filter(r.calls, lambda c: c > o.t - 864000000000) end
  from r join o on o.user_id = r.user_id and o.k = r.k + 1)
select event_id, allowed from r""")
def limiter_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential admission: a call passes if fewer than three admitted ones lie in the ten days before it."""
    return folds.admit(T(spark, sf_dir, "events"), "user_id", "event_id", "ts", limit=3, seconds=864_000)


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by 1, 2")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert semantics: the latest version of each key."""
    return T(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("select n_nationkey as host, unnest(range(1, 2 + n_regionkey)) as slot from nation")
def weighted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host as often as its rate over the smallest one."""
    return T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("host"), F.explode(F.expr("sequence(1L, cast(1 + n_regionkey as bigint))")).alias("slot"))


@query("select s_suppkey, row_number() over (order by case when s_acctbal < 0 then 1 else 0 end, s_nationkey % 3, -s_acctbal, s_name) as place from supplier where s_nationkey <> 3")
def provider_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured providers by composite rank: those that failed last, then the tier, then the balance."""
    s = T(spark, sf_dir, "supplier").where("s_nationkey <> 3").withColumn("tier", F.when(F.col("s_acctbal") < 0, 3).otherwise(0) + F.col("s_nationkey") % 3)
    return W.global_rank(s.withColumn("down", -F.col("s_acctbal")), "tier", F.col("tier").cast("double"), "down", "s_name").select("s_suppkey", "place")


@query(V.with_(V.LINES, body="""
, a as (select ord, line from lines where doc_id % 2 = 0), b as (select ord, line from lines where doc_id % 2 = 1),
x as (select a.doc_id, a.ord, a.line, b.line as other from (select doc_id // 2 as doc_id, ord, line from lines where doc_id % 2 = 0) a full outer join (select doc_id // 2 as doc_id, ord, line from lines where doc_id % 2 = 1) b using (doc_id, ord))
select doc_id, count(*) filter (where line is null) as appeared, count(*) filter (where other is null) as disappeared, count(*) filter (where line <> other) as changed from (
  select coalesce(a.doc_id, b.doc_id) as doc_id, a.line, b.line as other from (select doc_id // 2 as doc_id, ord, line from lines where doc_id % 2 = 0) a full outer join (select doc_id // 2 as doc_id, ord, line from lines where doc_id % 2 = 1) b on a.doc_id = b.doc_id and a.ord = b.ord) group by 1"""))
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional difference of neighbouring documents."""
    l = V.lines(spark, sf_dir).select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), "ord", "line")  # noqa: E741
    left = l.where("side = 0").select("pair", "ord", "line")
    right = l.where("side = 1").select("pair", "ord", F.col("line").alias("other"))
    both = left.join(right, ["pair", "ord"], "full")
    return both.groupBy(F.col("pair").alias("doc_id")).agg(F.count_if(F.col("line").isNull()).alias("appeared"), F.count_if(F.col("other").isNull()).alias("disappeared"), F.count_if(F.col("line") != F.col("other")).alias("changed"))


@query("""
with r as (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || '7'), doc_id) as k, count(*) over (partition by lang) as n, count(*) over () as total from documents)
select doc_id, lang from r where k <= cast(round_even(100 * n / total::double, 0) as bigint)""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 100 documents with the shares of the languages."""
    return folds.stratified(T(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100, 7)


@query("""select l.quality as truth, cast(case when d.n_chars >= 400 then 1 else 0 end as integer) as predicted, count(*) as n, cast(sum(case when l.quality = 1 and d.n_chars < 400 then 1 else 0 end) as bigint) as false_unanswered
from labels l join documents d using (doc_id) group by 1, 2""")
def mapping_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("n_chars") >= 400, 1).otherwise(0)
    j = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy(F.col("quality").alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") < 400)).alias("false_unanswered"))


@query("""
with t as (select o_custkey as c, o_orderpriority as label from orders where o_orderkey % 2 = 0), p as (select o_custkey as c, o_orderpriority as label from orders where o_orderkey % 2 = 1),
b as (select c, count(*) as shared from (select c, label from t intersect all select c, label from p) group by 1),
n as (select coalesce(t.c, p.c) as c, coalesce(t.n, 0) as nt, coalesce(p.n, 0) as np from (select c, count(*) as n from t group by 1) t full outer join (select c, count(*) as n from p group by 1) p on t.c = p.c)
select n.c as custkey, coalesce(shared, 0) as matched, nt - coalesce(shared, 0) as missed, np - coalesce(shared, 0) as invented, round(2 * coalesce(shared, 0) / (nt + np)::double, 6) as f1 from n left join b using (c)""")
def extraction_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection of labels, and F1."""
    o = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey"), "o_orderpriority").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("t"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("p"))
    n = o.groupBy("custkey").agg(F.sum(F.least("t", "p")).alias("matched"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return n.select("custkey", "matched", (F.col("t") - F.col("matched")).alias("missed"), (F.col("p") - F.col("matched")).alias("invented"), F.round(2 * F.col("matched") / (F.col("t") + F.col("p")), 6).alias("f1"))


@query("""
with f as (select o_orderkey, o_orderstatus, o_totalprice as awarded, 1000.0 * (o_custkey % 200) as low, 1000.0 * (o_custkey % 200) + 100000 as high from orders)
select o_orderstatus as status, count(*) as n, count(*) filter (where awarded between low and high) as in_band, count(*) filter (where awarded < 5000 and low > 0) as false_zero,
  count(*) filter (where awarded > high) as false_credit, round(avg(abs(awarded - (low + high) / 2)), 2) as mean_error from f group by 1""")
def scoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awarded marks against bands: inside, false zeros, false credit, and the error from the middle."""
    low = 1000.0 * (F.col("o_custkey") % 200)
    f = T(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("awarded"), low.alias("low"), (low + 100000).alias("high"))
    return marking.scoring(f, ["o_orderstatus"], zero_below=5000).withColumnRenamed("o_orderstatus", "status")


@query(V.with_(V.VOTES, body=", t as (select check_id, sample, count(*) filter (where met) as total from votes group by 1, 2) select check_id, max(total) - min(total) as spread, count(*) as runs from t group by 1"))
def mark_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.votes(spark, sf_dir).groupBy("check_id", "sample").agg(F.count_if("met").alias("total"))
    return t.groupBy("check_id").agg((F.max("total") - F.min("total")).alias("spread"), F.count("*").alias("runs"))


@query("""
select o_orderkey, 'read_nothing' as failure from orders where o_totalprice < 2000 union all select o_orderkey, 'out_of_band' from orders where o_totalprice > 300000
union all select o_orderkey, 'never_judged' from orders where o_orderstatus = 'P' union all select o_orderkey, 'denominator' from orders where o_custkey % 97 = 0""")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the gate, one row for each that fails: a single pass over the facts."""
    rules = {"read_nothing": "o_totalprice < 2000", "out_of_band": "o_totalprice > 300000", "never_judged": "o_orderstatus = 'P'", "denominator": "o_custkey % 97 = 0"}
    failed = F.filter(F.array(*[F.when(F.expr(rule), name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return T(spark, sf_dir, "orders").select("o_orderkey", F.explode(failed).alias("failure"))


@query("""select quality, count(*) filter (where n_chars < 500) as low, count(*) filter (where n_chars >= 500 and n_chars < 3000) as middle, count(*) filter (where n_chars >= 3000) as high
from labels join documents using (doc_id) group by 1""")
def band_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("n_chars") < 500, "low").when(F.col("n_chars") < 3000, "middle").otherwise("high")
    j = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", band.alias("band")), "doc_id")
    return j.groupBy("quality").pivot("band", ["low", "middle", "high"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""
with o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as a, o_totalprice as b from orders),
p as (select x.o_custkey, sign(y.b - x.b) as s from o x join o y on x.o_custkey = y.o_custkey and x.a < y.a)
select o_custkey, round(sum(s) / nullif(count(*) filter (where s <> 0), 0)::double, 6) as tau from p group by 1""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concordant - discordant) / both, ties left out; customers with two orders or more."""
    return folds.kendall(T(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("""
with recursive o as (select o_custkey, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderkey) as k from orders),
r as (select o_custkey, k, [v] as tails from o where k = 1 union all
  select o.o_custkey, o.k, case when len(list_filter(r.tails, lambda t: t <= o.v)) = len(r.tails) then list_append(r.tails, o.v)
    else list_concat(list_concat(r.tails[1:len(list_filter(r.tails, lambda t: t <= o.v))], [o.v]), r.tails[len(list_filter(r.tails, lambda t: t <= o.v)) + 2:]) end
  from r join o on o.o_custkey = r.o_custkey and o.k = r.k + 1)
select o_custkey, cast(max(len(tails)) as integer) as longest from r group by 1""")
def lis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the longest non-decreasing subsequence of totals, by customer."""
    return folds.longest_run(T(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("""
with recursive o as (select o_custkey, o_orderkey, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders),
r as (
  select o_custkey, k, [v] as tails, [1] as ends, [0] as before from o where k = 1
  union all
  select o.o_custkey, o.k,
    list_concat(list_concat(r.tails[1:c], [o.v]), r.tails[c + 2:]), list_concat(list_concat(r.ends[1:c], [cast(o.k as integer)]), r.ends[c + 2:]),
    list_append(r.before, case when c = 0 then 0 else r.ends[c] end)
  from (select r.*, o.v as ov, len(list_filter(r.tails, lambda t: t <= o.v)) as c from r join o on o.o_custkey = r.o_custkey and o.k = r.k + 1) r
  join o on o.o_custkey = r.o_custkey and o.k = r.k + 1),
f as (select o_custkey, before, ends[len(ends)] as last from r join (select o_custkey, max(k) as k from r group by 1) using (o_custkey, k) where k > 1),
t as (select o_custkey, before, cast(last as integer) as spot from f union all select o_custkey, before, cast(before[spot] as integer) from t where before[spot] > 0)
select o.o_custkey, o.o_orderkey, t.spot is not null as in_order from o left join t on o.o_custkey = t.o_custkey and o.k = t.spot""")
def lis_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which totals are on the longest non-decreasing subsequence of their customer."""
    return folds.in_longest_run(T(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
