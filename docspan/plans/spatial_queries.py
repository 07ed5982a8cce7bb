"""Spatial queries over line boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.functions import geometry as G
from docspan.operators import spatial as S
from docspan.plans import views as V
from docspan.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_IOU = f"({_INTER}) / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER})"


def sql(body: str) -> str:
    return V.with_(V.BOXES, body=body)


def _halves(spark: SparkSession, sf_dir: str, left: str = "id % 2 = 0", right: str = "id % 2 = 1") -> tuple[DataFrame, DataFrame]:
    b = V.boxes(spark, sf_dir)
    return S.prefixed(b.where(left), "a"), S.prefixed(b.where(right), "b")


@query(sql("select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from boxes group by 1"))
def hull_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hull(V.boxes(spark, sf_dir), "page")


@query(sql(f"select a.id as a_id, b.id as b_id, round({_IOU}, 6) as iou from boxes a join boxes b on a.page = b.page and a.id < b.id where {_IOU} >= 0.3"))
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir, "true", "true")
    score = G.iou(G.box("a_"), G.box("b_"))
    return S.overlap_pairs(a, b, (F.col("a_id") < F.col("b_id")) & (score >= 0.3)).select("a_id", "b_id", F.round(score, 6).alias("iou"))


_POINTS = [(0.10, 0.20), (0.25, 0.50), (0.40, 0.75)]


@query(sql("""
, p as (select * from (values (0.10::double, 0.20::double), (0.25, 0.50), (0.40, 0.75)) t(x, y))
select page, x, y, arg_min(id, ((x1 - x0) * (y1 - y0), id)) as id from boxes, p where x between x0 and x1 and y between y0 and y1 group by 1, 2, 3"""))
def box_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest box of each page under each of three points."""
    points = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _POINTS])).alias("p")
    b = V.boxes(spark, sf_dir).select("*", points).select("*", "p.x", "p.y").where(G.contains_point(G.box(), F.col("x"), F.col("y")))
    return b.groupBy("page", "x", "y").agg(F.min_by("id", F.struct(G.area(G.box()), F.col("id"))).alias("id"))


@query(sql("select id, cast(round_even(x0 * 1000, 0) as integer) as gx0, cast(round_even(y1 * 1000, 0) as integer) as gy1, abs(round_even(x0 * 1000, 0) / 1000 - x0) < 1e-9 as exact from boxes"))
def hgbench_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda c: F.bround(F.col(c) * 1000, 0)
    return V.boxes(spark, sf_dir).select("id", g("x0").cast("int").alias("gx0"), g("y1").cast("int").alias("gy1"), (F.abs(g("x0") / 1000 - F.col("x0")) < 1e-9).alias("exact"))


_SAME = f"(({_INTER}) / {_AREA.format('a')} >= 0.3 or ({_INTER}) / {_AREA.format('b')} >= 0.3)"


def _same_marking() -> F.Column:
    a, b = G.box("a_"), G.box("b_")
    both = G.intersection(a, b)
    return (both / G.area(a) >= 0.3) | (both / G.area(b) >= 0.3)


@query(sql(f"""
, h as (select a.id, count(*) as n from boxes a join boxes b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 and {_SAME} group by 1)
select a.id, h.id is not null as covered, coalesce(n, 0) as n_lines from boxes a left join h using (id) where a.id % 2 = 0"""))
def ink_cover_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink (even boxes) that some line (odd boxes) describes, by 30 % of either."""
    a, b = _halves(spark, sf_dir)
    hits = S.overlap_pairs(a, b, _same_marking()).groupBy("a_id").agg(F.count("*").alias("n"))
    return a.join(hits, "a_id", "left").select(F.col("a_id").alias("id"), F.col("n").isNotNull().alias("covered"), F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(sql(f"select distinct b.id from boxes a join boxes b on a.page = b.page and a.id % 7 = 0 and b.id % 7 <> 0 and {_AREA.format('a')} <= 0.10 and ({_INTER}) / {_AREA.format('b')} >= 0.3"))
def excluded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which 30 % lie in a struck or bled region (every seventh box)."""
    a, b = _halves(spark, sf_dir, "id % 7 = 0", "id % 7 <> 0")
    inside = (G.area(G.box("a_")) <= 0.10) & (G.intersection(G.box("a_"), G.box("b_")) / G.area(G.box("b_")) >= 0.3)
    return S.overlap_pairs(a, b, inside).select(F.col("b_id").alias("id")).distinct()


@query(sql(f"""
, s as (select a.id as ink, b.id % 10 as block, round(sum((({_INTER}) / {_AREA.format('a')})::decimal(18,9)), 6)::double as share from boxes a join boxes b on a.page = b.page and a.id % 3 = 0 and b.id % 3 <> 0 and ({_INTER}) > 0 group by 1, 2)
select ink, arg_max(block, (share, -block)) as block, max(share) as share from s group by 1 having max(share) >= 0.3"""))
def ink_best_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block with the largest part of each ink region, if that is 30 %."""
    a, b = _halves(spark, sf_dir, "id % 3 = 0", "id % 3 <> 0")
    both = G.intersection(G.box("a_"), G.box("b_"))
    s = S.overlap_pairs(a, b, both > 0).groupBy(F.col("a_id").alias("ink"), (F.col("b_id") % 10).alias("block")).agg(F.round(F.sum((both / G.area(G.box("a_"))).cast("decimal(18,9)")), 6).cast("double").alias("share"))
    return s.groupBy("ink").agg(F.max_by("block", F.struct("share", -F.col("block"))).alias("block"), F.max("share").alias("share")).where("share >= 0.3")


_RATIO = "l_orderkey % 100 / 200.0::double"


@query("""select l_orderkey, l_linenumber, l_quantity, l_partkey, case when l_partkey % 1000 < 200 or l_suppkey % 100 / 200.0::double < 0.02 then 'noise' when l_linenumber = 7 and (l_quantity > 20 or l_quantity < 0.05) then 'noise'
 when l_discount < 0.02 then 'bleed' else 'writing' end as kind from lineitem""")
def ink_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = S.ink_kind(F.col("l_partkey") % 1000, F.col("l_suppkey") % 100 / 200.0, F.col("l_discount") * 7.5, F.col("l_linenumber") == 7, F.col("l_quantity"))
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", kind.alias("kind"))


@query(sql("select page, coalesce(median(y1 - y0) filter (where id % 2 = 0), median(y1 - y0)) as baseline from boxes group by 1"))
def density_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over confidently read regions, else over all."""
    h = F.col("y1") - F.col("y0")
    return V.boxes(spark, sf_dir).groupBy("page").agg(F.coalesce(F.median(F.when(F.col("id") % 2 == 0, h)), F.median(h)).alias("baseline"))


@query(sql("select page, round(least(sum(case when id % 3 = 0 then (x1 - x0) * (y1 - y0) else 0 end) / nullif(sum((x1 - x0) * (y1 - y0)), 0), 1), 6) as share, round(sum((x1 - x0) * (y1 - y0) * 0.2), 6) as ink_ratio from boxes group by 1"))
def unassigned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.area(G.box())
    return V.boxes(spark, sf_dir).groupBy("page").agg(F.round(F.least(F.sum(F.when(F.col("id") % 3 == 0, a).otherwise(0)) / F.nullif(F.sum(a), F.lit(0.0)), F.lit(1.0)), 6).alias("share"), F.round(F.sum(a * 0.2), 6).alias("ink_ratio"))


@query(sql("""
, g as (select page, y0 - lag(y1) over (partition by page order by y0, id) as gap from boxes),
k as (select page, list_sort(list(gap)) as gaps from g where gap >= 0 group by 1)
select p.page, round(greatest(coalesce(gaps[cast(floor(len(gaps) * 0.30) as bigint) + 1], 0.02), 0.004), 6) as spacing from (select distinct page from boxes) p left join k using (page)"""))
def normal_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30th percentile of the non-negative gaps down each page, 0.004 at least."""
    g = V.boxes(spark, sf_dir).select("page", (F.col("y0") - F.lag("y1").over(Window.partitionBy("page").orderBy("y0", "id"))).alias("gap"))
    gaps = F.sort_array(F.collect_list(F.when(F.col("gap") >= 0, F.col("gap"))))
    at = F.try_element_at("gaps", (F.floor(F.size("gaps") * 0.30) + 1).cast("int"))
    return g.groupBy("page").agg(gaps.alias("gaps")).select("page", F.round(F.greatest(F.coalesce(at, F.lit(0.02)), F.lit(0.004)), 6).alias("spacing"))


@query(sql("""
, k as (select page, list_sort(list(x0)) as xs, list_sort(list(y1 - y0)) as hs, min(x0) as leftmost from boxes group by 1)
select page, xs[len(xs) // 2 + 1] as body_left, round(hs[len(hs) // 2 + 1], 6) as line_height, leftmost <= xs[len(xs) // 2 + 1] - 0.030 as margin_labels from k"""))
def body_left_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of left edges and heights, and whether something stands out to the left."""
    k = V.boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list("x0")).alias("xs"), F.sort_array(F.collect_list(F.col("y1") - F.col("y0"))).alias("hs"), F.min("x0").alias("leftmost"))
    upper = lambda c: F.element_at(c, F.expr(f"cast(size({c}) div 2 + 1 as int)"))
    return k.select("page", upper("xs").alias("body_left"), F.round(upper("hs"), 6).alias("line_height"), (F.col("leftmost") <= upper("xs") - 0.030).alias("margin_labels"))


@query(sql("""
, o as (select *, max(y1) over (partition by page order by y0, id rows between unbounded preceding and 1 preceding) as above from boxes),
g as (select *, sum(case when above is null or y0 - above > 0.002 then 1 else 0 end) over (partition by page order by y0, id) as island from o)
select page, cast(island as bigint) as island, count(*) as n, min(y0) as y0, max(y1) as y1 from g group by 1, 2"""))
def ink_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.islands(V.boxes(spark, sf_dir), "page", F.lit(0.002))
    return g.groupBy("page", "island").agg(F.count("*").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


@query(sql("select id, page, row_number() over (partition by page order by round_even(y0 / (0.036::double * 0.6::double), 0), x0, id) as place from boxes"))
def reading_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reading_order(V.boxes(spark, sf_dir), "page", F.lit(0.036)).select("id", "page", F.col("place").cast("long").alias("place"))


@query(sql("""
, b as (select distinct page, unnest(range(cast(floor(x0 * 200) as bigint), cast(floor(x1 * 200) as bigint) + 1)) as bin from boxes where x1 - x0 < 0.09),
g as (select page, bin, bin - lag(bin) over (partition by page order by bin) - 1 as hole from b)
select page, count(*) filter (where hole >= 7) as gutters, count(*) as covered from g group by 1"""))
def column_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gutters of seven or more empty bins in the projection of the narrow boxes."""
    narrow = V.boxes(spark, sf_dir).where("x1 - x0 < 0.09")
    bins = narrow.select("page", F.explode(F.sequence(F.floor(F.col("x0") * 200), F.floor(F.col("x1") * 200))).alias("bin")).distinct()
    g = bins.withColumn("hole", F.col("bin") - F.lag("bin").over(Window.partitionBy("page").orderBy("bin")) - 1)
    return g.groupBy("page").agg(F.count_if(F.col("hole") >= 7).alias("gutters"), F.count("*").alias("covered"))


_CUTS = """
, p as (select page, min(x0) as l, greatest(max(x1) - min(x0), 0.000000001) as span from boxes group by 1),
n as (select b.*, p.l, p.span from boxes b join p using (page) where x1 - x0 < 0.62 * span),
c as (select distinct page, unnest(range(cast(floor((x0 - l) / span * 200) as bigint), least(200, cast(floor((x1 - l) / span * 200) as bigint) + 1))) as bin from n),
b as (select page, unnest(range(0, 200)) as bin from p), h as (select b.page, b.bin, max(case when c.bin is not null then b.bin end) over (partition by b.page order by b.bin) as filled from b left join c using (page, bin)),
g as (select h.page, l + (h.bin - 3.5) / 200 * span as cut from h join p using (page) where h.bin - coalesce(filled, -1) = 7 and h.bin > 7),
k as (select boxes.id, count(g.cut) as col from boxes left join g on boxes.page = g.page and (boxes.x0 + boxes.x1) / 2 > g.cut group by 1),
s as (select page, col, count(*) as n from boxes join k using (id) group by 1, 2), f as (select page, count(*) < 2 or min(n) < 3 as one, count(*) as cols from s group by 1),
o as (select page, id, case when one then 0 else col end::integer as col, one, x0, y0 from boxes join k using (id) join f using (page))
select page, id, col, cast(row_number() over (partition by page order by col, y0, x0, id) as integer) as place, case when one then 1.0 else 0.75 end::double as confidence from o"""


@query(sql(_CUTS))
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_order(V.boxes(spark, sf_dir))


@query(sql("""
, o as (select *, lag(y1) over w as up, lead(y0) over w as down from boxes window w as (partition by page order by y0, id))
select id, round(case when up is null then y0 else (up + y0) / 2 end, 6) as top, round(case when down is null then y1 else (y1 + down) / 2 end, 6) as bottom from o"""))
def box_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands that meet halfway between neighbouring rows."""
    w = Window.partitionBy("page").orderBy("y0", "id")
    o = V.boxes(spark, sf_dir).withColumn("up", F.lag("y1").over(w)).withColumn("down", F.lead("y0").over(w))
    return o.select("id", F.round(F.coalesce((F.col("up") + F.col("y0")) / 2, F.col("y0")), 6).alias("top"), F.round(F.coalesce((F.col("y1") + F.col("down")) / 2, F.col("y1")), 6).alias("bottom"))


@query(V.with_(V.BOXES.replace("boxes as", "recursive boxes as", 1), body="""
, e as (select a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id <> b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),
reach as (select id as a, id as b from boxes union select r.a, e.b from reach r join e on r.b = e.a),
g as (select a as id, min(b) as first from reach group by 1)
select page, first, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from boxes join g using (id) group by 1, 2"""))
def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_overlapping(V.boxes(spark, sf_dir))


@query(sql(f"""
, i as (select a.page, sum({_INTER}) as s from boxes a join boxes b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 group by 1),
t as (select page, sum((x1 - x0) * (y1 - y0)) as s from boxes group by 1)
select page, round(coalesce(i.s, 0) / (t.s - coalesce(i.s, 0)), 6) as iou from t left join i using (page)"""))
def page_iou_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of intersections over sum of unions by page (overlaps within a side count twice)."""
    a, b = _halves(spark, sf_dir)
    both = G.intersection(G.box("a_"), G.box("b_"))
    i = S.overlap_pairs(a, b, both > 0).groupBy(F.col("a_page").alias("page")).agg(F.sum(both).alias("i"))
    t = V.boxes(spark, sf_dir).groupBy("page").agg(F.sum(G.area(G.box())).alias("t"))
    i_ = F.coalesce("i", F.lit(0.0))
    return t.join(i, "page", "left").select("page", F.round(i_ / (F.col("t") - i_), 6).alias("iou"))


@query(V.with_(V.BOXES.replace("boxes as", "recursive boxes as", 1), body=f"""
, p as (select a.page, a.id as t, b.id as p, {_IOU} as score from boxes a join boxes b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 and ({_INTER}) > 0 where {_IOU} >= 0.3),
c as (select page, t, list(p order by score desc, p) as ps, row_number() over (partition by page order by t) as k from p group by 1, 2),
r as (select page, k, ps[1:1] as used from c where k = 1 union all select c.page, c.k, list_concat(r.used, (list_filter(c.ps, lambda x: not list_contains(r.used, x)))[1:1]) from r join c on c.page = r.page and c.k = r.k + 1),
n as (select page, count(*) as n_truth from boxes where id % 2 = 0 group by 1), f as (select page, max(len(used)) as n_found from r group by 1)
select page, n_truth, coalesce(n_found, 0) as n_found from n left join f using (page)"""))
def greedy_line_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.boxes(spark, sf_dir)
    return S.greedy_recall(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.30)


@query(sql(f"""select distinct a.id from boxes a join boxes b on a.page = b.page and a.id <> b.id and b.x0 > a.x1
  and (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.5"""))
def writing_to_the_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with another line further right on their row."""
    a, b = _halves(spark, sf_dir, "true", "true")
    beside = (F.col("a_id") != F.col("b_id")) & (F.col("b_x0") > F.col("a_x1")) & (G.vertical_overlap(G.box("a_"), G.box("b_")) >= 0.5)
    return S.overlap_pairs(a, b, beside).select(F.col("a_id").alias("id")).distinct()


@query(sql("""
select id, (x1 - x0) * (y1 - y0) >= 0.004 and id % 3 <> 0 as substantive, id % 4 = 1 and not (id % 3 = 0) as orphan_ink, (x0 + x1) / 2 as cx, greatest(x0 - 0.01, 0) as ex0, least(y1 + 0.01, 1) as ey1 from boxes"""))
def box_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates and derived geometry of regions: substantive, orphan, centre, expansion within the page."""
    third = F.col("id") % 3 == 0
    return V.boxes(spark, sf_dir).select("id", ((G.area(G.box()) >= 0.004) & ~third).alias("substantive"), ((F.col("id") % 4 == 1) & ~third).alias("orphan_ink"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.greatest(F.col("x0") - 0.01, F.lit(0.0)).alias("ex0"), F.least(F.col("y1") + 0.01, F.lit(1.0)).alias("ey1"))
