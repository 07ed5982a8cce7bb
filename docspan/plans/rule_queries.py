"""Gates of alignment, small rules of marking and review, and report figures, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.functions import geometry as G
from docspan.functions import patterns as P
from docspan.functions import review as R
from docspan.functions import rules as X
from docspan.operators import similarity as SIM
from docspan.operators import spatial as S
from docspan.plans import views as V
from docspan.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
T = V.table

_DRAW = P.DRAWING.replace("'", "''")
_KIND = f"case when regexp_matches(text, '{_DRAW}') then 'DRAWING'" + "".join(f" when regexp_matches(text, '{pattern}') then '{name}'" for name, pattern in ((n, "(?i)\\b(?:" + "|".join(v) + ")\\b") for n, v in P.EVIDENCE_VERBS)) + " else 'RECALL' end"


@query("""with m as (select l_orderkey, list_sort(list(l_linenumber) filter (where l_quantity < 10)) as line_ids, list_sort(list(l_linenumber) filter (where l_quantity >= 40)) as ink_ids from lineitem group by 1)
select l_orderkey, len(coalesce(line_ids, [])) = 0 and len(coalesce(ink_ids, [])) > 0 as text_free, case when len(coalesce(line_ids, [])) = 0 and len(coalesce(ink_ids, [])) > 0 then 'ink_regions' else 'ocr_lines' end as derived_from from m""")
def text_free_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with ink and no line, and what their highlight comes from."""
    ids = lambda rule: F.collect_list(F.when(F.expr(rule), F.col("l_linenumber")))
    m = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids("l_quantity < 10").alias("line_ids"), ids("l_quantity >= 40").alias("ink_ids"))
    free = (F.size("line_ids") == 0) & (F.size("ink_ids") > 0)
    return m.select("l_orderkey", free.alias("text_free"), F.when(free, "ink_regions").otherwise("ocr_lines").alias("derived_from"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_discount * 10 < 0.60 as low_confidence, l_returnflag = 'R' or (l_returnflag = 'A' and l_discount * 10 < 0.55) as mapping_review,
  not l_linestatus = 'F' and (l_tax > 0.06 or l_discount * 10 < 0.6) as grade_review from lineitem""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read badly, mappings and grades that a person should see."""
    sure = F.col("l_discount") * 10
    return T(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (sure < X.LOW_CONFIDENCE).alias("low_confidence"),
        ((F.col("l_returnflag") == "R") | ((F.col("l_returnflag") == "A") & (sure < X.UNSURE_MAPPING))).alias("mapping_review"),
        (~(F.col("l_linestatus") == "F") & ((F.col("l_tax") > 0.06) | (sure < X.UNSURE_GRADE))).alias("grade_review"),
    )


_QUESTIONS = """questions as (select p_partkey, case p_partkey % 5 when 0 then 'Draw a diagram of ' || p_name when 1 then 'Explain ' || p_name when 2 then 'Mark the river on the map' when 3 then 'Calculate the cost' else p_name end as text,
  case when p_size % 3 = 0 then '' when p_size % 3 = 1 then '  ' else p_brand end as answer, p_size % 4 / 10.0::double as hint, p_size % 5 = 0 as goes_on, p_size % 7 as n_lines, p_size % 4 as low from part)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case p_partkey % 5 when 0 then 'Draw a diagram of ' || p_name when 1 then 'Explain ' || p_name when 2 then 'Mark the river on the map' when 3 then 'Calculate the cost' else p_name end as text",
        "case when p_size % 3 = 0 then '' when p_size % 3 = 1 then '  ' else p_brand end as answer", "p_size % 4 / 10.0D as hint", "p_size % 5 = 0 as goes_on", "p_size % 7 as n_lines", "p_size % 4 as low",
    )


@query(f"with {_QUESTIONS} select p_partkey, trim(answer) <> '' or hint > 0 or regexp_matches(text, '{_DRAW}') as plausible, trim(answer) <> '' or goes_on or regexp_matches(text, '{_DRAW}') as may_continue from questions")
def text_free_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block could be a question's answer, and whether the answer may carry on into it."""
    q, a = F.col("text"), F.col("answer")
    return _questions(spark, sf_dir).select("p_partkey", X.text_free_plausible(q, a, F.col("hint")).alias("plausible"), X.may_continue(q, a, F.col("goes_on")).alias("may_continue"))


@query(f"with {_QUESTIONS}, k as (select *, {_KIND} as kind from questions) select p_partkey, n_lines > 0 and (kind in ('WORKING', 'SYMBOLIC', 'DRAWING') or least(low, n_lines) / n_lines::double >= 0.5) as reread from k")
def rereading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers worth a second reading."""
    return _questions(spark, sf_dir).select("p_partkey", F.coalesce(X.worth_rereading(F.col("text"), F.least("low", "n_lines"), F.col("n_lines")), F.lit(False)).alias("reread"))


_PATHS = """paths as (select c_custkey, c_nationkey, [cast(c_nationkey % 3 as varchar), cast(c_custkey % 4 as varchar), cast(c_custkey % 5 as varchar)][1:1 + c_custkey % 3] as path, case when c_custkey % 11 = 0 then ' ' else c_name end as text from customer),
pairs as (select c_custkey, path as owner, lead(path) over (partition by c_nationkey order by c_custkey) as candidate, text from paths)"""


@query(f"""with {_PATHS} select c_custkey, trim(text) <> '' and (owner[1:len(owner) - 1] = candidate[1:len(candidate) - 1] or candidate[1:len(owner)] = owner or owner[1:len(candidate)] = candidate) as may_share,
  trim(text) <> '' and greatest(len(owner), len(candidate)) > 1 and ((len(owner) > 1 and owner[1:len(owner) - 1] = candidate[1:len(candidate) - 1])
    or (len(owner) < len(candidate) and candidate[1:len(owner)] = owner) or (len(candidate) < len(owner) and owner[1:len(candidate)] = candidate)) as parts_of_one
from pairs where candidate is not null""")
def relation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring questions that one block may answer together, and parts of one numbered question."""
    c = T(spark, sf_dir, "customer")
    path = F.slice(F.array((c["c_nationkey"] % 3).cast("string"), (c["c_custkey"] % 4).cast("string"), (c["c_custkey"] % 5).cast("string")), F.lit(1), (1 + c["c_custkey"] % 3).cast("int"))
    rows = c.select("c_custkey", "c_nationkey", path.alias("owner"), F.when(c["c_custkey"] % 11 == 0, " ").otherwise(c["c_name"]).alias("text"))
    pairs = rows.withColumn("candidate", F.lead("owner").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("candidate is not null")
    o, n, t = F.col("owner"), F.col("candidate"), F.col("text")
    return pairs.select("c_custkey", X.may_share(o, n, t).alias("may_share"), X.parts_of_one(o, n, t).alias("parts_of_one"))


def _sql(body: str) -> str:
    return V.with_(V.BOXES, body=body)


@query(_sql("""
, o as (select id, page % 10 as sheet, page // 10 as leaf, y0, lag(page // 10) over w as end_page, lag(y1) over w as end_y1 from boxes window w as (partition by page % 10 order by page // 10, y0, id))
select id, case when leaf = end_page then y0 - end_y1 <= 0.12 when leaf = end_page + 1 then y0 <= 0.25 else false end as runs_on from o where end_page is not null"""))
def runs_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that start where the block before ends, on its page or at the top of the next."""
    b = V.boxes(spark, sf_dir).selectExpr("id", "page % 10 as sheet", "page div 10 as leaf", "y0", "y1")
    w = Window.partitionBy("sheet").orderBy("leaf", "y0", "id")
    b = b.withColumn("end_page", F.lag("leaf").over(w)).withColumn("end_y1", F.lag("y1").over(w)).where("end_page is not null")
    return b.select("id", X.runs_on(F.col("end_page"), F.col("end_y1"), F.col("leaf"), F.col("y0")).alias("runs_on"))


_OVERLAP = "greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least(a.y1 - a.y0, b.y1 - b.y0)"


@query(_sql(f"select a.id as a_id, b.id as b_id from boxes a join boxes b on a.page = b.page and a.id < b.id and {_OVERLAP} >= 0.5 and greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 0.08"))
def same_row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one line of writing."""
    a, b = S.prefixed(V.boxes(spark, sf_dir), "a"), S.prefixed(V.boxes(spark, sf_dir), "b")
    return S.overlap_pairs(a, b, (F.col("a_id") < F.col("b_id")) & X.same_row(G.box("a_"), G.box("b_"))).select("a_id", "b_id")


_NEXT = "o as (select *, row_number() over (partition by page order by y0, x0, id) as k, count(*) over (partition by page) as n from boxes), p as (select a.id as a_id, b.id as b_id, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1 from o a join o b on a.page = b.page and b.k = a.k + 1)"


@query(_sql(f""", {_NEXT} select a_id, b_id, by0 - ay1 <= greatest(ay1 - ay0, by1 - by0) * 1.2 and least(ax1, bx1) - greatest(ax0, bx0) > 0 and (least(ax1, bx1) - greatest(ax0, bx0)) / least(ax1 - ax0, bx1 - bx0) >= 0.15 as joins from p"""))
def band_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line continues the band of the line before it on the page."""
    w = Window.partitionBy("page").orderBy("y0", "x0", "id")
    here = V.boxes(spark, sf_dir)
    pairs = here.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("id", "x0", "y0", "x1", "y1")]).where("p_id is not null")
    return pairs.select(F.col("p_id").alias("a_id"), F.col("id").alias("b_id"), X.joins(G.box("p_"), G.box()).alias("joins"))


@query(_sql("""
, o as (select *, row_number() over w as k, count(*) over (partition by page) as n, lag(y1) over w as up, lead(y0) over w as down, min(x0) over (partition by page) as l, max(x1) over (partition by page) as r from boxes window w as (partition by page order by y0, id))
select id, case when k = 1 then x0 else l end as x0, round(least(case when k = 1 then y0 else (up + y0) / 2 end, y0), 6) as y0, case when k = n then x1 else r end as x1, round(greatest(case when k = n then y1 else (y1 + down) / 2 end, y1), 6) as y1 from o"""))
def band_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of lines as a text selection: rows meet halfway, and only the first and the last are ragged."""
    every = Window.partitionBy("page")
    w = every.orderBy("y0", "id")
    o = V.boxes(spark, sf_dir).withColumns({"up": F.lag("y1").over(w), "down": F.lead("y0").over(w), "left": F.min("x0").over(every), "right": F.max("x1").over(every)})
    first, last = F.col("up").isNull(), F.col("down").isNull()
    top = F.when(first, F.col("y0")).otherwise((F.col("up") + F.col("y0")) / 2)
    bottom = F.when(last, F.col("y1")).otherwise((F.col("y1") + F.col("down")) / 2)
    return o.select("id", F.when(first, F.col("x0")).otherwise(F.col("left")).alias("x0"), F.round(F.least(top, "y0"), 6).alias("y0"), F.when(last, F.col("x1")).otherwise(F.col("right")).alias("x1"), F.round(F.greatest(bottom, "y1"), 6).alias("y1"))


@query(_sql("""
, s as (select id, page, x0, x1, floor(y0 * 20) / 20 as y0, (floor(y0 * 20) + 1) / 20 as y1 from boxes),
o as (select *, lag(x0) over w as ux0, lag(x1) over w as ux1, lag(y1) over w as uy1, lead(x0) over w as dx0, lead(x1) over w as dx1, lead(y0) over w as dy0 from s window w as (partition by page order by y0, id)),
f as (select id, coalesce(abs(y0 - uy1) <= 0.000001 and least(ux1, x1) > greatest(ux0, x0), false) as above, coalesce(abs(dy0 - y1) <= 0.000001 and least(dx1, x1) > greatest(dx0, x0), false) as below from o)
select id, case when above and below then 'middle' when below then 'top' when above then 'bottom' else 'only' end as edge from f"""))
def stack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each box sits in a stack of touching boxes."""
    w = Window.partitionBy("page").orderBy("y0", "id")
    s = V.boxes(spark, sf_dir).select("id", "page", "x0", "x1", (F.floor(F.col("y0") * 20) / 20).alias("y0"), ((F.floor(F.col("y0") * 20) + 1) / 20).alias("y1"))
    o = s.select("*", *[F.lag(c).over(w).alias(f"u_{c}") for c in ("x0", "y0", "x1", "y1")], *[F.lead(c).over(w).alias(f"d_{c}") for c in ("x0", "y0", "x1", "y1")])
    above, below = F.coalesce(X.touches(G.box("u_"), G.box()), F.lit(False)), F.coalesce(X.touches(G.box(), G.box("d_")), F.lit(False))
    return o.select("id", F.when(above & below, "middle").when(below, "top").when(above, "bottom").otherwise("only").alias("edge"))


@query(_sql("select page, count(*) as n, array_to_string(list_sort(list(id)), ',') as ids from boxes where id % 4 = 1 and id % 3 <> 0 group by 1"))
def untranscribed_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan ink by page."""
    orphan = V.boxes(spark, sf_dir).where("id % 4 = 1 and id % 3 <> 0")
    return orphan.groupBy("page").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


_STRUCK = "case when l_partkey % 1000 < 200 or l_suppkey % 100 / 200.0 < 0.02 then 'noise' when l_linenumber = 7 and (l_quantity > 20 or l_quantity < 0.05) then 'noise' when l_discount < 0.02 then 'bleed' when l_tax > 0.07 then 'struck_through' else 'writing' end"


@query(f"with k as (select l_orderkey, l_linenumber, l_quantity, {_STRUCK.replace('200.0', '200.0::double')} as kind from lineitem) select l_orderkey, l_linenumber, l_quantity from k where kind = 'struck_through'")
def struck_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of writing that are struck through."""
    return T(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", _STRUCK.replace("200.0", "200.0D") + " as kind").where("kind = 'struck_through'").drop("kind")


@query(_sql("""
, s as (select page, y0, x0, x1, y1, (x1 - x0) * (y1 - y0) as area, id % 20 as ans from boxes), a as (select ans, page, sum(area) as total, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from s group by 1, 2),
r as (select *, row_number() over (partition by ans order by round(total, 9) desc, page) as k from a)
select ans, page, round(greatest(x0 - 0.1 * (x1 - x0), 0), 6) as x0, round(greatest(y0 - 0.1 * (y1 - y0), 0), 6) as y0, round(least(x1 + 0.1 * (x1 - x0), 1), 6) as x1, round(least(y1 + 0.1 * (y1 - y0), 1), 6) as y1 from r where k = 1"""))
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that holds most of an answer, and its hull with a tenth around it, inside the page."""
    a = V.boxes(spark, sf_dir).groupBy((F.col("id") % 20).alias("ans"), "page").agg(F.sum(G.area(G.box())).alias("total"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    best = a.groupBy("ans").agg(F.max_by(F.struct("page", "x0", "y0", "x1", "y1"), F.struct(F.round("total", 9), -F.col("page"))).alias("b")).select("ans", "b.*")
    pad = lambda lo, hi: 0.1 * (F.col(hi) - F.col(lo))
    grown = lambda lo, hi: [F.round(F.greatest(F.col(lo) - pad(lo, hi), F.lit(0.0)), 6).alias(lo), F.round(F.least(F.col(hi) + pad(lo, hi), F.lit(1.0)), 6).alias(hi)]
    return best.select("ans", "page", *grown("x0", "x1"), *grown("y0", "y1"))


@query(_sql("""
, b as (select a.page, ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) as i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s from boxes a join boxes b on a.page = b.page and a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),
u as (select page, i / (s - i) as iou from b)
select page, round(avg(iou), 6) as mean, round(avg(case when iou >= 0.5 then 1 else 0 end), 6) as at_50, round(avg(case when iou >= 0.75 then 1 else 0 end), 6) as at_75, count(*) as n from u group by 1"""))
def iou_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of the pairs of a page that meet, and the shares at the two thresholds."""
    a, b = S.prefixed(V.boxes(spark, sf_dir), "a"), S.prefixed(V.boxes(spark, sf_dir), "b")
    met = S.overlap_pairs(a, b, (F.col("a_id") < F.col("b_id")) & (G.intersection(G.box("a_"), G.box("b_")) > 0)).withColumn("iou", G.iou(G.box("a_"), G.box("b_")))
    share = lambda t: F.round(F.avg((F.col("iou") >= t).cast("int")), 6)
    return met.groupBy(F.col("a_page").alias("page")).agg(F.round(F.avg("iou"), 6).alias("mean"), share(0.5).alias("at_50"), share(0.75).alias("at_75"), F.count("*").alias("n"))


_WARN = "case e.event_id % 9 when 0 then 'Answers were NOT marked: no provider' when 1 then 'Placed by wording rather than by meaning' when 2 then 'A page may be missing' when 3 then 'No questions were extracted' when 4 then 'Two pages read' when 5 then 'The page could not be read' when 6 then 'Writing could not be located' when 7 then 'multiple columns on page 2' else e.event_type end"


@query(f"""with w as (select event_id, lower({_WARN}) as t from events e)
select event_id, case when {" or ".join(f"contains(t, '{p}')" for p in X.BLOCKING)} then 'blocking' when {" or ".join(f"contains(t, '{p}')" for p in X.DEGRADED)} then 'degraded' else 'informational' end as severity from w""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How loudly each warning is shown."""
    return T(spark, sf_dir, "events").alias("e").select("event_id", X.severity(F.expr(_WARN)).alias("severity"))


_IDS = "['as:' || lpad(cast(l_orderkey % 50 as varchar), 4, '0'), 'as:0007', 'qp:7', 'as:7x']"


@query(f"""with c as (select l_orderkey, l_linenumber, l_partkey, l_quantity, {_IDS} as known,
  case l_linenumber when 1 then 'as:' || lpad(cast(l_orderkey % 50 as varchar), 6, '0') when 2 then 'as:7' when 3 then 'qp:007' when 4 then 'as:99' when 5 then 'as:7x' when 6 then 'none' else 'as:0007' end as cited from lineitem),
s as (select *, list_filter(known, lambda k: regexp_extract(k, '^(.*):([0-9]+)$', 1) = regexp_extract(cited, '^(.*):([0-9]+)$', 1) and try_cast(regexp_extract(k, '^(.*):([0-9]+)$', 2) as bigint) = try_cast(regexp_extract(cited, '^(.*):([0-9]+)$', 2) as bigint)) as same from c)
select l_orderkey, l_linenumber, l_partkey, l_quantity, cited, case when list_contains(known, cited) or regexp_extract(cited, '^(.*):([0-9]+)$', 2) = '' or len(list_distinct(same)) <> 1 then cited else same[1] end as meant from s""")
def citation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by the line that they mean: zero padding is no difference where one line answers to the number."""
    known = F.array_distinct(F.expr("array('as:' || lpad(cast(l_orderkey % 50 as string), 4, '0'), 'as:0007', 'qp:7', 'as:7x')"))
    cited = F.expr("case l_linenumber when 1 then 'as:' || lpad(cast(l_orderkey % 50 as string), 6, '0') when 2 then 'as:7' when 3 then 'qp:007' when 4 then 'as:99' when 5 then 'as:7x' when 6 then 'none' else 'as:0007' end")
    c = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", cited.alias("cited"), known.alias("known"))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "cited", X.padded_citation(F.col("cited"), F.col("known")).alias("meant"))


@query("""with g as (select l_orderkey, count(*) filter (where l_quantity >= 20) as awarded, count(*) filter (where l_quantity >= 20 and l_tax > 0.02) as cited, count(*) filter (where l_discount > 0.09) as unevidenced from lineitem group by 1),
s as (select *, case when awarded = 0 then 0.8 else round_even(0.5 + 0.5 * cited / awarded::double, 2) end as share from g)
select l_orderkey, case when unevidenced > 0 then least(share, 0.5) else share end::double as confidence from s""")
def cited_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in a grade by what its awarded points cite."""
    g = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("count_if(l_quantity >= 20)").alias("awarded"), F.expr("count_if(l_quantity >= 20 and l_tax > 0.02)").alias("cited"), F.expr("count_if(l_discount > 0.09)").alias("unevidenced"))
    return g.select("l_orderkey", X.cited_share(F.col("awarded"), F.col("cited"), F.col("unevidenced")).cast("double").alias("confidence"))


@query("""with q as (select c_custkey, case c_custkey % 4 when 0 then 'A/' || (c_custkey % 30) || '/i' when 1 then (c_custkey % 30) || '/' || (c_custkey % 7) when 2 then (c_custkey % 30) || '/a/2/9/4' else 'B' end as qid from customer),
p as (select c_custkey, qid, string_split(qid, '/') as parts from q)
select c_custkey, qid, cast(list_sum(list_transform(range(1, len(parts) + 1), lambda i: case when regexp_full_match(parts[i], '[0-9]+') then cast(parts[i] as bigint) * cast(1000 ** (3 - least(i - 1, 3)) as bigint) else 0 end)) as bigint) as position from p""")
def position_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that sort question ids."""
    qid = F.expr("case c_custkey % 4 when 0 then 'A/' || (c_custkey % 30) || '/i' when 1 then (c_custkey % 30) || '/' || (c_custkey % 7) when 2 then (c_custkey % 30) || '/a/2/9/4' else 'B' end")
    return T(spark, sf_dir, "customer").select("c_custkey", qid.alias("qid")).withColumn("position", X.position_key(F.col("qid")))


_RAW = "case p_partkey % 9 when 0 then (p_partkey % 30) || '.' when 1 then (p_partkey % 30) || ' (a)' when 2 then '(i)' when 3 then ' iv. ' when 4 then (p_partkey % 30) || ' b)' when 5 then 'Section B' when 6 then '--' when 7 then (p_partkey % 30) || '' else 'Q' || (p_partkey % 30) end"
_NUMBERED, _BARE = r"^(\d+)\s*[.)]?\s*(?:\(\s*([A-Za-z]+)\s*\)|([A-Za-z]+)[.)])?\s*$", r"^\(?\s*([A-Za-z0-9]{1,4})\s*\)?\s*[.)]?$"


@query(f"""with l as (select p_partkey, trim({_RAW}) as t, case when p_size % 2 = 0 then [cast(p_size as varchar), 'x'] else [cast(p_size as varchar)] end as path from part),
f as (select *, regexp_matches(t, '{_NUMBERED}') as numbered, regexp_matches(t, '{_BARE}') as bare, regexp_extract(t, '{_BARE}', 1) as token, coalesce(nullif(regexp_extract(t, '{_NUMBERED}', 2), ''), nullif(regexp_extract(t, '{_NUMBERED}', 3), '')) as letter, substr(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'), 1, 3) as short from l)
select p_partkey, case when numbered then regexp_extract(t, '{_NUMBERED}', 1) when bare then case when len(path) > 1 then path[1] else token end when short = '' then '?' else short end as badge,
  case when numbered then letter || '.' when bare and len(path) > 1 then token || '.' end as sub from f""")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed labels as a badge and a part."""
    path = F.expr("case when p_size % 2 = 0 then array(cast(p_size as string), 'x') else array(cast(p_size as string)) end")
    label = X.split_label(F.expr(_RAW), path)
    return T(spark, sf_dir, "part").select("p_partkey", label["badge"].alias("badge"), label["sub"].alias("sub"))


_LOG = "case event_id % 6 when 0 then 'key sk-abcdefgh' || event_id || 'xyz sent' when 1 then 'AKIA' || lpad(cast(event_id as {s}), 16, '7') || ' used' when 2 then 'Authorization: Bearer abc.def-ghi' || event_id || '123 ok' when 3 then repeat('boilerplate ', 30) || 'quotaMetric: requests limit: 20 retry in 30s' when 4 then repeat('long text ', 40) else 'short ' || event_type end"
_CRED, _QUOTA = "|".join(P.CREDENTIALS), X.QUOTA


@query(f"""with l as (select event_id, {_LOG.format(s="varchar")} as t from events), r as (select event_id, regexp_replace(t, '{_CRED}', '\\1\\2\\3...[redacted]', 'g') as t from l),
k as (select *, (select coalesce(string_agg(x, ' ' order by i), '') from (select x, min(i) as i from (select unnest(regexp_extract_all(t, '{_QUOTA}', 1)) as x, generate_subscripts(regexp_extract_all(t, '{_QUOTA}', 1), 1) as i) group by x)) as kept from r)
select event_id, case when length(t) <= 300 then t when kept = '' then substr(t, 1, 300) else substr(substr(t, 1, greatest(0, 300 - length(kept) - 5)) || ' ... ' || kept, 1, 300 + length(kept) + 5) end as told from k""")
def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines without credentials, trimmed but for what they say about quotas."""
    return T(spark, sf_dir, "events").select("event_id", X.trim_message(X.redact(F.expr(_LOG.format(s="string")))).alias("told"))


@query("""with p as (select p_partkey, case when p_partkey % 10 = 0 then '' else p_name end as truth, case when p_partkey % 20 < 3 then '' when p_partkey % 3 = 0 then p_type else substr(p_name, 2) || 'e' end as read from part)
select p_partkey, case when truth = '' then case when read = '' then 0 else 1 end else round(levenshtein(truth, read) / length(truth)::double, 6) end::double as cer from p""")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates with the cases of an empty truth."""
    p = T(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_partkey % 10 = 0 then '' else p_name end as truth", "case when p_partkey % 20 < 3 then '' when p_partkey % 3 = 0 then p_type else substr(p_name, 2) || 'e' end as read")
    return p.select("p_partkey", F.round(X.character_error_rate(F.col("truth"), F.col("read")), 6).cast("double").alias("cer"))


@query("""with e as (select p_partkey, round(levenshtein(p_name, p_type) / length(p_name)::double, 6) as cer from part) select p_partkey, cer from e order by cer desc, p_partkey limit 5""")
def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages with the highest error rate (the report's list)."""
    e = T(spark, sf_dir, "part").select("p_partkey", F.round(X.character_error_rate(F.col("p_name"), F.col("p_type")), 6).cast("double").alias("cer"))
    return e.orderBy(F.desc("cer"), "p_partkey").limit(5)


@query("""with m as (select l_orderkey, l_linenumber as k, cast(l_tax * 100 as integer) as marks, l_returnflag as criterion, l_linestatus as note, l_partkey as tie from lineitem)
select l_orderkey, string_agg('  ' || k2 || '. [' || marks || case when marks = 1 then ' mark] ' else ' marks] ' end || criterion || chr(10) || '     ' || note, chr(10) order by k2) as lines, sum(marks)::bigint as available, 0.0::double as awarded, 'rubric_only' as graded_by
from (select *, row_number() over (partition by l_orderkey order by k, marks, criterion, note) as k2 from m) group by 1""")
def rubric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rubric text, and the grade of a question that nobody has marked."""
    m = T(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.round(F.col("l_tax") * 100).cast("int").alias("marks"), F.col("l_returnflag").alias("criterion"), F.col("l_linestatus").alias("note")).alias("c"))
    g = m.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("criteria"), F.sum("c.marks").alias("available"))
    return g.select("l_orderkey", X.criterion_lines(F.col("criteria")).alias("lines"), "available", F.lit(0.0).alias("awarded"), F.lit("rubric_only").alias("graded_by"))


_EDGE = """e as (select id, page % 20 as script, page // 20 as leaf, x0, y0, case when id % 3 = 0 then 'Roll No: 37' when id % 7 = 0 then 'RollNo 3' || id % 2 else 'Q' || id || 'zz' || id * 7 end as text from boxes where y0 <= 0.12 or y0 >= 0.88),
b as (select *, cast(round_even(y0 / 0.03, 0) as bigint) as by_, cast(round_even(x0 / 0.12, 0) as bigint) as bx from e where length(text) between 1 and 24),
n as (select page % 20 as script, count(distinct page // 20) as pages from boxes group by 1),
g as (select script, by_, bx from b join n using (script) where pages >= 2 group by script, by_, bx, pages having count(distinct leaf) >= greatest(2, pages // 2)),
m as (select b.* from b join g using (script, by_, bx)),
t as (select id, script, by_, bx, unnest(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) as gram from (select *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as s from m)),
c as (select id, script, by_, bx, gram, count(*) as tf from t group by all), l as (select id, sqrt(sum(tf * tf)::double) as norm from c group by 1),
s as (select x.script, x.by_, x.bx, sum(x.tf * y.tf) / any_value(lx.norm) / any_value(ly.norm) as score from c x join c y on x.script = y.script and x.by_ = y.by_ and x.bx = y.bx and x.gram = y.gram and x.id < y.id join l lx on lx.id = x.id join l ly on ly.id = y.id group by x.script, x.by_, x.bx, x.id, y.id)"""


@query(_sql(f", {_EDGE} select distinct m.id from m join s using (script, by_, bx) where score >= 0.15"))
def edge_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines at the page edge that recur in one place on half of a script's pages, of which some two say the same."""
    b = V.boxes(spark, sf_dir).selectExpr("id", "page % 20 as script", "page div 20 as leaf", "x0", "y0", "case when id % 3 = 0 then 'Roll No: 37' when id % 7 = 0 then 'RollNo 3' || id % 2 else 'Q' || id || 'zz' || id * 7 end as text")
    edge = b.where("(y0 <= 0.12 or y0 >= 0.88) and length(text) between 1 and 24").select("*", F.bround(F.col("y0") / 0.03).cast("long").alias("by"), F.bround(F.col("x0") / 0.12).cast("long").alias("bx"))
    pages = b.groupBy("script").agg(F.count_distinct("leaf").alias("pages")).where("pages >= 2")
    spot = edge.join(pages, "script").groupBy("script", "by", "bx", "pages").agg(F.count_distinct("leaf").alias("on")).where(F.col("on") >= F.greatest(F.lit(2), F.expr("pages div 2"))).select("script", "by", "bx")
    m = edge.join(spot, ["script", "by", "bx"]).select("id", F.concat_ws(":", "script", "by", "bx").alias("spot"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("plain"))
    return m.join(SIM.keys_with_alike(m, "spot", "id", "plain", 0.15), "spot", "left_semi").select("id")


@query(_sql("""
, o as (select *, row_number() over (partition by page order by y0, id) as k from boxes), s as (select * from o where x1 - x0 <= 0.1),
m as (select s.id, s.page, s.k, max(struct_pack(w := b.x1 - b.x0, neg := -b.k)) as widest from s join o b on s.page = b.page and s.id <> b.id and (least(s.y1, b.y1) - greatest(s.y0, b.y0)) / least(s.y1 - s.y0, b.y1 - b.y0) >= 0.5 group by 1, 2, 3)
select id, -widest.neg = k + 1 as bound from m"""))
def label_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the widest line on a margin number's row is the line that follows it."""
    o = V.boxes(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("y0", "id")).cast("long"))
    return S.widest_beside(o, F.expr("x1 - x0 <= 0.1")).select("id", (F.col("widest") == F.col("k") + 1).alias("bound"))


@query("""with b as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_partkey % 7 as page, o_orderkey % 7 as truth, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey)
select o_orderstatus as status, count(*) filter (where page = truth) as hits, count(*) as seen, round(avg(case when page = truth then 1 else 0 end), 6) as share from b group by 1""")
def placement_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed lines whose page is the truth's, by status."""
    o = T(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    b = T(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("hit", F.expr("l_partkey % 7 = o_orderkey % 7"))
    return b.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("seen"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))


_DEV = "d as (select l_orderkey as block, l_linenumber as q, max(round(l_quantity / 50, 4)) as dev, max(l_partkey % 4) as part from lineitem group by 1, 2)"


@query(f"""with {_DEV}, r as (select *, row_number() over (partition by block order by dev desc, q desc) as k, count(*) over (partition by block) as n from d),
t as (select block, max(dev) filter (where k = 1) as best, max(dev) filter (where k = 2) as second, max(q) filter (where k = 1) as winner, max(part) filter (where k = 1) as wpart from r group by 1)
select block, q, dev from d join t using (block) where second is null or best - second < 0.25 or q = winner or (best > 0 and part = wpart)""")
def withheld_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs left once a block that leads to one question by the decisive margin keeps to it and to its other parts."""
    d = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("q")).agg(F.max(F.round(F.col("l_quantity") / 50, 4)).alias("dev"), F.max(F.col("l_partkey") % 4).alias("part"))
    w = Window.partitionBy("block").orderBy(F.desc("dev"), F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = d.withColumns({"best": F.first("dev").over(w), "winner": F.first("q").over(w), "wpart": F.first("part").over(w), "second": F.nth_value("dev", 2).over(w)})
    decided = F.coalesce(F.col("best") - F.col("second") >= 0.25, F.lit(False))
    return t.where(~decided | (F.col("q") == F.col("winner")) | ((F.col("best") > 0) & (F.col("part") == F.col("wpart")))).select("block", "q", "dev")


@query("""with b as (select conv_id, turn, length(trim(text)) as chars, case when turn % 3 <> 2 then conv_id % 4 + turn // 4 end as decided, row_number() over (partition by conv_id order by turn) as k from conversations),
p as (select *, last_value(case when chars > 12 then struct_pack(d := decided) end ignore nulls) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding) as before from b)
select conv_id, turn, coalesce(decided = before.d, false) as agrees from p""")
def agrees_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block is decided on the question that the last block of more than a dozen characters was decided on."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    decided = F.when(F.col("turn") % 3 != 2, F.col("conv_id") % 4 + F.expr("turn div 4"))
    b = T(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.trim("text")).alias("chars"), decided.alias("decided"))
    before = F.last(F.when(F.col("chars") > 12, F.struct("decided")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("before", before).select("conv_id", "turn", F.coalesce(F.col("decided") == F.col("before.decided"), F.lit(False)).alias("agrees"))


@query("""with c as (select event_id, case event_id % 3 when 0 then '  the value is ' || event_type || ' ' when 1 then ' ' end as claim, case event_id % 4 when 0 then 'Does the answer state that ' || event_type || '?' when 1 then 'Is ' || event_type || ' named?' when 2 then 'Does the student name ' || event_type || '??' else '' end as ask from events),
s as (select *, trim(regexp_replace(trim(ask), '\\?+$', '')) as t, nullif(regexp_extract(trim(regexp_replace(trim(ask), '\\?+$', '')), '(?i)^(?:does|do|did|has|have)\\s+(?:the\\s+)?(?:answer|student|response)\\s+(.+)$', 1), '') as rest from c)
select event_id, coalesce(nullif(trim(claim), ''), nullif(case when rest is not null then 'The answer ' || string_split(rest, ' ')[1] || 's ' || regexp_replace(rest, '^\\S+\\s*', '') else t end, '')) as hypothesis from s""")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposition of a check: its claim, else its question as a statement, else none."""
    c = T(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 3 when 0 then '  the value is ' || event_type || ' ' when 1 then ' ' end as claim", "case event_id % 4 when 0 then 'Does the answer state that ' || event_type || '?' when 1 then 'Is ' || event_type || ' named?' when 2 then 'Does the student name ' || event_type || '??' else '' end as ask")
    return c.select("event_id", F.coalesce(F.nullif(F.trim("claim"), F.lit("")), F.nullif(R.as_statement(F.col("ask")), F.lit(""))).alias("hypothesis"))


@query(_sql("select page, row_number() over (partition by page % 2 order by page) - 1 as index_, case when page % 2 = 0 then 'question_paper' else 'answer_sheet' end as kind, n from (select page, count(*) as n from boxes group by 1) where page % 2 = 1"))
def kind_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one kind in their order."""
    pages = V.boxes(spark, sf_dir).where("page % 2 = 1").groupBy("page").agg(F.count("*").alias("n"))
    kind = F.when(F.col("page") % 2 == 0, "question_paper").otherwise("answer_sheet")
    return pages.select("page", (F.row_number().over(Window.partitionBy(kind).orderBy("page")) - 1).cast("long").alias("index_"), kind.alias("kind"), "n")


@query("""with j as (select l_orderkey as sub, l_suppkey % 3 as qid, round(l_tax * 50) as marks, l_quantity / 10 as given, l_returnflag = 'R' as satisfied, l_partkey % 6 as cites, l_discount from lineitem),
r as (select *, case when cites = 0 then 0 when satisfied then marks else least(greatest(given, 0), marks) end as earned, cites = 5 as bad from j)
select sub, qid, case when bool_or(bad) then 0 else round(sum(earned::decimal(18,4))::double, 4) end::double as awarded, sum(marks::decimal(18,2))::double as available, not bool_or(bad) as judged from r group by 1, 2""")
def point_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from scalar judgements: clamped, uncited credit is none, one invalid citation refuses the question."""
    j = T(spark, sf_dir, "lineitem").selectExpr("l_orderkey as sub", "l_suppkey % 3 as qid", "round(l_tax * 50) as marks", "l_quantity / 10 as given", "l_returnflag = 'R' as satisfied", "l_partkey % 6 as cites")
    earned = F.when(F.col("cites") == 0, F.lit(0.0)).when(F.col("satisfied"), F.col("marks")).otherwise(F.least(F.greatest("given", F.lit(0.0)), F.col("marks")))
    r = j.withColumn("earned", earned).withColumn("bad", F.col("cites") == 5)
    return r.groupBy("sub", "qid").agg(
        F.when(F.bool_or("bad"), 0.0).otherwise(F.round(F.sum(F.col("earned").cast("decimal(18,4)")).cast("double"), 4)).alias("awarded"), F.sum(F.col("marks").cast("decimal(18,2)")).cast("double").alias("available"), (~F.bool_or("bad")).alias("judged")
    )


@query("""select s_suppkey, greatest(n_nationkey % 4 + 1, 1) as weight, s_acctbal >= 0 and s_name is not null and n_name is not null as usable from supplier join nation on s_nationkey = n_nationkey""")
def usable_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload plans all of whose slots are signed."""
    s = T(spark, sf_dir, "supplier").join(T(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    slots = F.array(F.col("s_acctbal") >= 0, F.col("s_name").isNotNull(), F.col("n_name").isNotNull())
    return s.select("s_suppkey", F.greatest(F.col("n_nationkey") % 4 + 1, F.lit(1)).alias("weight"), F.forall(slots, lambda x: x).alias("usable"))


_R = "struct_pack(x0 := {0}.x0, y0 := {0}.y0, x1 := {0}.x1, y1 := {0}.y1)"
_LEVEL = "least(r.y1, b.y1) - greatest(r.y0, b.y0) > 0 and (least(r.y1, b.y1) - greatest(r.y0, b.y0)) / least(r.y1 - r.y0, b.y1 - b.y0) >= 0.5 and greatest(r.x0, b.x0) - least(r.x1, b.x1) <= 0.08"
_RUN = "struct_pack(x0 := {0}.x0, x1 := {0}.x1, y1 := {0}.y1, h := {0}.y1 - {0}.y0, members := [{1}])"


@query(V.with_(V.BOXES.replace("boxes as", "recursive boxes as", 1), body=f"""
, s as (select page * 10 + id % 6 as part, row_number() over (partition by page * 10 + id % 6 order by y0, x0, id) as k, {_R.format('boxes')} as b from boxes),
r as (
  select part, k, [b] as rows from s where k = 1
  union all
  select part, k, case when spot = 0 then list_append(rows, b) else list_concat(list_concat(rows[1:spot - 1], [struct_pack(x0 := least(rows[spot].x0, b.x0), y0 := least(rows[spot].y0, b.y0), x1 := greatest(rows[spot].x1, b.x1), y1 := greatest(rows[spot].y1, b.y1))]), rows[spot + 1:]) end
  from (select s.part, s.k, s.b, r.rows, coalesce(list_position(list_transform(r.rows, lambda r: {_LEVEL.replace('b.', 's.b.')}), true), 0) as spot from r join s on s.part = r.part and s.k = r.k + 1)),
l as (select part, unnest(rows) as b from r join (select part, max(k) as k from r group by 1) using (part, k)),
o as (select part, b, row_number() over (partition by part order by b.y0, b.x0) as k from l),
q as (
  select part, k, [{_RUN.format('b', 'k')}] as runs from o where k = 1
  union all
  select part, k, case when spot = 0 then list_append(runs, {_RUN.format('b', 'k')}) else list_concat(list_concat(runs[1:spot - 1], [struct_pack(x0 := least(runs[spot].x0, b.x0), x1 := greatest(runs[spot].x1, b.x1), y1 := greatest(runs[spot].y1, b.y1), h := greatest(runs[spot].h, b.y1 - b.y0), members := list_append(runs[spot].members, k))]), runs[spot + 1:]) end
  from (select o.part, o.k, o.b, q.runs, coalesce(list_position(list_transform(q.runs, lambda u: o.b.y0 - u.y1 <= greatest(o.b.y1 - o.b.y0, u.h) * 1.2 and least(u.x1, o.b.x1) - greatest(u.x0, o.b.x0) > 0 and (least(u.x1, o.b.x1) - greatest(u.x0, o.b.x0)) / least(u.x1 - u.x0, o.b.x1 - o.b.x0) >= 0.15), true), 0) as spot
    from q join o on o.part = q.part and o.k = q.k + 1)),
m as (select part, unnest(range(0, len(runs))) as band, unnest(runs) as u from q join (select part, max(k) as k from q group by 1) using (part, k)),
n as (select m.part, band, o.b, u.x0 as l, u.x1 as r, row_number() over w as i, count(*) over (partition by m.part, band) as c, lag(o.b.y1) over w as up, lead(o.b.y0) over w as down from m join o on o.part = m.part and list_contains(u.members, o.k) window w as (partition by m.part, band order by o.b.y0, o.k))
select part, band::integer as band, (i - 1)::integer as row, case when i = 1 then b.x0 else l end as x0, round(least(case when i = 1 then b.y0 else (up + b.y0) / 2 end, b.y0), 6) as y0, case when i = c then b.x1 else r end as x1, round(greatest(case when i = c then b.y1 else (b.y1 + down) / 2 end, b.y1), 6) as y1 from n"""))
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writing of an answer on a page as rows, bands and outlines."""
    found = S.highlights(V.boxes(spark, sf_dir).withColumn("part", F.col("page") * 10 + F.col("id") % 6), "part")
    return found.select("part", "band", "row", "x0", F.round("y0", 6).alias("y0"), "x1", F.round("y1", 6).alias("y1"))


@query("""with j as (select l_orderkey as sub_id, l_suppkey % 3 as qid, round(l_tax * 50) as marks, case when l_linenumber % 3 = 0 then null else l_quantity > 25 end as met, case when l_discount > 0.05 then 'no' else '' end as error, l_partkey % 7 = 0 as unverifiable, l_partkey % 4 as cite from lineitem),
r as (select *, (unverifiable and coalesce(met, true)) or (coalesce(met, false) and cite < 2) as credited, not coalesce(met, true) and error <> '' as refused from j)
select sub_id, qid, sum(case when credited then marks else 0 end)::double as awarded, sum(marks)::double as available, bool_or(not credited and not refused) as needs_review, count(*) filter (where not credited and not refused) as n_deferred from r group by 1, 2""")
def check_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from binary checks: met and cited, unverifiable, refused with a reason, or deferred."""
    from docspan.operators import marking

    j = T(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as sub_id", "l_suppkey % 3 as qid", "round(l_tax * 50) as marks", "case when l_linenumber % 3 = 0 then null else l_quantity > 25 end as met", "case when l_discount > 0.05 then 'no' else '' end as error",
        "l_partkey % 7 = 0 as unverifiable", "array(concat('as:', cast(l_partkey % 4 as string))) as cited", "array('as:0', 'as:1') as known",
    )
    return marking.assemble_checks(j)
