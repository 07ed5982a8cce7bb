"""Similarity, placement and alignment queries: documents act as answer blocks, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.functions import patterns as P
from docspan.functions import text as X
from docspan.operators import alignment, marking
from docspan.operators import similarity as S
from docspan.operators import windows as W
from docspan.plans import views as V
from docspan.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

MARGIN = 0.02  # decisive margin of the trigram measure on invented prose
_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)


def _tf(table: str, key: str, terms: str) -> str:
    return f"(select {key}, term, tf, sqrt(sum(tf * tf) over (partition by {key})::double) as norm from (select {key}, term, count(*) as tf from ({terms.format(table=table, key=key)}) group by 1, 2))"


_GRAMS = "select {key}, unnest([substr(s, i, 3) for i in range(1, greatest(length(s) - 2, 1) + 1)]) as term from (select {key}, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as s from {table}) where length(s) > 0"
_WORDS = f"select * from (select {{key}}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from {{table}}) where length(term) > 1 and term not in ({_STOP})"


def _scores(name: str, terms: str) -> str:
    return f"{name} as (select doc_id, item_id, round(sum(a.tf * b.tf) / any_value(a.norm) / any_value(b.norm), 6) as score from {_tf('documents', 'doc_id', terms)} a join {_tf('benchmark', 'item_id', terms)} b using (term) group by 1, 2)"


TRIGRAM, LEXICAL = _scores("scores", _GRAMS), _scores("lexical", _WORDS)


def _found(spark: SparkSession, sf_dir: str, *measures: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the given columns and the scored questions of each document."""
    return S.scored(V.table(spark, sf_dir, "documents").select("doc_id", *columns, "text"), V.table(spark, sf_dir, "benchmark"), "doc_id", "item_id", *(measures or ("trigram",)))


@query(f"with {TRIGRAM} select * from scores where score >= 0.3")
def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs_of(_found(spark, sf_dir), "doc_id", "item_id", 0.3)


@query(f"with {LEXICAL} select * from lexical where score >= 0.3")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs_of(_found(spark, sf_dir, "lexical"), "doc_id", "item_id", 0.3)


@query(f"with {TRIGRAM}, {LEXICAL} select doc_id, item_id, max(score) as score from (select * from scores union all select * from lexical) group by 1, 2 having max(score) >= 0.3")
def stronger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs_of(_found(spark, sf_dir, "trigram", "lexical"), "doc_id", "item_id", 0.3)


_TWO = f"""with {TRIGRAM}, r as (select *, row_number() over (partition by doc_id order by score desc, item_id) as k from scores),
two as (select doc_id, max(item_id) filter (where k = 1) as best, max(score) filter (where k = 1) as score, max(item_id) filter (where k = 2) as second, coalesce(max(score) filter (where k = 2), 0) as second_score from r where k <= 2 group by 1)"""


@query(f"{_TWO} select *, round(score - second_score, 6) >= {MARGIN} as decided from two")
def place_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best question and runner-up of each block, with the decisive margin."""
    return S.best_two(_found(spark, sf_dir), "doc_id", MARGIN)


@query(f"{_TWO} select doc_id, score as ceiling, second_score as runner_up from two")
def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_two(_found(spark, sf_dir), "doc_id", MARGIN).select("doc_id", F.col("score").alias("ceiling"), F.col("second_score").alias("runner_up"))


@query(f"with {TRIGRAM}, n as (select count(*) as n from benchmark), m as (select doc_id, sum(score::decimal(18,6))::double as total from scores group by 1) select doc_id, item_id, cast(floor((score - total / n) * 1000 + 0.0000001) as bigint) as centred from scores join m using (doc_id), n where score - total / n >= 0.1000001")
def centred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation from the block's mean over all questions, where it is a tenth or more."""
    n = V.table(spark, sf_dir, "benchmark").count()
    total = F.aggregate("pairs", F.lit(0).cast("decimal(38,6)"), lambda t, p: (t + p["score"].cast("decimal(18,6)")).cast("decimal(38,6)")).cast("double")
    s = S.pairs_of(_found(spark, sf_dir).withColumn("mean", total / n).withColumn("pairs", F.transform("pairs", lambda p: F.struct(p["item"].alias("item"), (p["score"] - F.col("mean")).alias("score")))), "doc_id", "item_id", 0.1000001)
    return s.select("doc_id", "item_id", F.floor(F.col("score") * 1000 + 0.0000001).cast("long").alias("centred"))


@query(f"{_TWO} select doc_id, best, row_number() over (order by score desc, doc_id) as place from two where round(score - second_score, 6) >= {MARGIN}")
def decided_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided blocks, strongest first: places inside ranges of the score, behind the sizes of the ranges before."""
    two = S.best_two(_found(spark, sf_dir), "doc_id", MARGIN).where("decided").select("doc_id", "best", "score")
    return W.global_rank(two, "score", -two["score"], "doc_id").select("doc_id", "best", "place")


@query(f"""with {TRIGRAM}, d as (select doc_id, row_number() over (partition by source order by doc_id) - 1 as j, count(*) over (partition by source) as m from documents),
b as (select item_id, row_number() over (order by item_id) - 1 as i, count(*) over () as n from benchmark)
select doc_id, item_id, round(1 - abs(coalesce(i / nullif(n - 1, 0)::double, 0) - coalesce(j / nullif(m - 1, 0)::double, 0)), 6) as prior from scores join d using (doc_id) join b using (item_id) where score >= 0.3""")
def order_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior of place of every scored pair: a question's place among all questions against the block's in its source."""
    w = Window.partitionBy("source")
    blocks = V.table(spark, sf_dir, "documents").select("doc_id", "text", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("j"), F.count("*").over(w).alias("m"))
    items = V.table(spark, sf_dir, "benchmark")
    found = S.scored(blocks, items, "doc_id", "item_id", "trigram").select("doc_id", "j", "m", F.explode(F.filter("pairs", lambda p: p["score"] >= 0.3)).alias("p"))
    places = W.global_rank(items.select("item_id"), "item_id", items["item_id"]).select(F.col("item_id").alias("item"), (F.col("place") - 1).alias("i"))
    n = items.agg(F.count("*")).scalar()
    return found.join(places, F.col("p.item") == F.col("item")).select("doc_id", F.col("item").alias("item_id"), F.round(S.order_prior(F.col("i"), n, F.col("j"), F.col("m")), 6).alias("prior"))


@query(f"""with {TRIGRAM}, n as (select count(*) as n from benchmark), m as (select doc_id, sum(score) as total, max(score) as best from scores group by 1),
l as (select item_id, greatest(6, length(text) / 6.0::double) as expected from benchmark), w as (select doc_id, greatest(1, n_chars / 6.0::double) as words from documents)
select doc_id, item_id, round(score - total / n + 0.2 * least(words, expected) / greatest(words, expected), 5) as cell from scores join m using (doc_id) join l using (item_id) join w using (doc_id), n
where score >= 0.70 * best and score > 0.1""")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live cells: deviation plus length support, within 0.70 of the block's best and above the floor."""
    n = V.table(spark, sf_dir, "benchmark").count()
    found = _found(spark, sf_dir, columns=("n_chars",)).withColumns({"total": S.total_score(), "best": S.best_score(), "words": F.greatest(F.lit(1.0), F.col("n_chars") / 6.0)})
    s = found.select("doc_id", "total", "words", F.explode(F.filter("pairs", lambda p: (p["score"] >= 0.70 * F.col("best")) & (p["score"] > 0.1))).alias("p"))
    items = V.table(spark, sf_dir, "benchmark").select("item_id", F.greatest(F.lit(6.0), F.length("text") / 6.0).alias("expected"))
    return s.join(items, F.col("p.item") == F.col("item_id")).select("doc_id", "item_id", F.round(F.col("p.score") - F.col("total") / n + 0.2 * F.least("words", "expected") / F.greatest("words", "expected"), 5).alias("cell"))


_PLAUSIBLE = S.threshold(0.0, 0.30, 0.20)


@query(f"with {TRIGRAM} select item_id, count(s.doc_id) > 0 as plausible, count(s.doc_id) as blocks from benchmark left join (select item_id, doc_id from scores where score >= {_PLAUSIBLE}) s using (item_id) group by 1")
def plausible_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some block reaches a fifth of the measure's band for each question, and how many do."""
    hits = S.pairs_of(_found(spark, sf_dir), "doc_id", "item_id", _PLAUSIBLE).groupBy("item_id").agg(F.count("*").alias("n"))
    return V.table(spark, sf_dir, "benchmark").select("item_id").join(hits, "item_id", "left").select("item_id", F.col("n").isNotNull().alias("plausible"), F.coalesce("n", F.lit(0)).alias("blocks"))


@query(f"with {TRIGRAM}, c as (select doc_id, item_id, score from scores where item_id = doc_id % 40), r as (select doc_id, max(score) as best from scores group by 1) select doc_id, item_id, best - score >= {S.threshold(0.0, 0.30, 0.15)} as outscored from c join r using (doc_id)")
def rival_outscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another question beats the claimed one by 0.15 of the measure's band."""
    s = _found(spark, sf_dir).select("doc_id", (F.col("doc_id") % 40).alias("item_id"), S.best_score().alias("best"), S.score_of(F.col("doc_id") % 40).alias("score")).where("score is not null")
    return s.select("doc_id", "item_id", (F.col("best") - F.col("score") >= S.threshold(0.0, 0.30, 0.15)).alias("outscored"))


@query(f"""with {TRIGRAM}, r as (select doc_id, max(score) as best from scores group by 1), c as (select d.doc_id, d.doc_id % 50 as claimed, s.score, r.best from documents d left join scores s on s.doc_id = d.doc_id and s.item_id = d.doc_id % 50 left join r on r.doc_id = d.doc_id)
select doc_id, case when score is null then case when doc_id % 3 = 0 then 'unverified' else 'disputed' end when best - score >= 0.045 and doc_id % 2 = 1 then 'disputed' when score >= 0.6 then 'confirmed' when doc_id % 2 = 0 then 'confirmed' else 'unverified' end as status from c""")
def anchor_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the written label of each block (claimed question: doc_id % 50)."""
    d = _found(spark, sf_dir).select("doc_id", S.best_score().alias("best"), S.score_of(F.col("doc_id") % 50).alias("score"))
    status = marking.anchor_status(F.col("score").isNotNull(), F.col("doc_id") % 3 == 0, F.col("best") - F.col("score") >= 0.045, F.col("doc_id") % 2 == 0, F.col("score") >= 0.6)
    return d.select("doc_id", status.alias("status"))


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings),
n as (select *, sqrt(list_dot_product(v, v)) as norm from e),
p as (select a.vec_id, b.vec_id as other, round(list_dot_product(a.v, b.v) / a.norm / b.norm, 6) as score from n a join n b on a.label = b.label and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by score desc, other) as k from p) select vec_id, other, score, k from r where k <= 3""")
def embed_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of the same label."""
    return S.nearest(V.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 3)


_DOCS = 20


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, tuple[str, ...], float]]]:
    """Segments of twenty blocks of a source against all questions: scored pairs, lengths, continuations and written labels."""
    w = Window.partitionBy("source").orderBy("doc_id")
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars", F.row_number().over(w).alias("bj"))
    docs = docs.withColumn("segment", F.concat_ws(":", "source", F.expr(f"(bj - 1) div {_DOCS}").cast("string")))
    benchmark = V.table(spark, sf_dir, "benchmark")
    found = S.scored(docs.withColumn("goes_on", X.mentions_continuation(F.col("text"))), benchmark, "doc_id", "item_id", "trigram")
    blocks = found.select(
        "segment", F.col("bj").alias("ordinal"), F.col("doc_id").alias("block"), "pairs", (F.col("n_chars") / 6.0).alias("words"), F.col("n_chars").alias("chars"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"),
        (F.col("doc_id") % 3 == 0).alias("runs_on"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 50).alias("label"),
    )
    items = benchmark.select("item_id", F.greatest(F.lit(6.0), F.length("text") / 6.0).alias("e")).orderBy("item_id").limit(S.SENT_POSTINGS).collect()
    return blocks, [(r.item_id, (str(r.item_id // 5), str(r.item_id % 5)), r.e) for r in items]


@query()
def align_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best monotone path of every segment."""
    blocks, items = _sheets(spark, sf_dir)
    return alignment.by_sheet(blocks, items, alignment.align_sheet, "segment").drop("how")


@query()
def claims_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, decided blocks, continuations, joins and the path for the rest; how tells the pass."""
    blocks, items = _sheets(spark, sf_dir)
    return alignment.by_sheet(blocks, items, alignment.assign, "segment").withColumnRenamed("how", "by")


def _classified_sql() -> str:
    """The paper-line classifier as a recursion over the lines of a paper."""
    from docspan.plans.text_queries import label_sql, q

    test = lambda p: f"regexp_matches(x.plain, {q(p)})"
    rubric = " or ".join(f"contains(lower(x.plain), {q(p)})" for p in P.INSTRUCTION_PHRASES)
    quotes = "['\"', '“', '‘', '''']"
    return f"""with recursive {V.PAPER_LINES}, {label_sql("paper_lines")},
x as (select l.paper_id, row_number() over (partition by l.paper_id order by l.ord) as k, l.ord, l.text, trim(l.text) as plain, p.raw is not null as label, length(p.remainder) as rest, regexp_full_match(p.tokens[1], '[0-9]{{1,3}}') as numbered from paper_lines l left join parsed p using (paper_id, ord)),
n as (select a.paper_id, a.k, min(b.k) as spot from x a join x b on a.paper_id = b.paper_id and b.k between a.k + 1 and a.k + 12 and (length(b.plain) >= 12 or b.label) where a.label group by 1, 2),
y as (select n.paper_id, n.k, not x.label as body_below from n join x on x.paper_id = n.paper_id and x.k = n.spot),
f as (select x.*, coalesce(rest >= 3, false) or coalesce(body_below, false) as has_body, {test(P.SECTION_HEADER)} as header, {rubric} as rubric,
  list_contains({quotes}, substr(x.plain, 1, 1)) as quote, {test(P.ONLY_MARKS)} as only_marks, {test(P.PAGE_NUMBER)} as page_number, {test(P.PER_QUESTION_MARKS)} or {test(P.MARKS_EACH)} as per, {test(P.BRACKETED_ASIDE)} as aside,
  {test(P.POINTS_AT_ITS_PARTS)} and (x.plain like '%:' or {test(P.INVITES_ANSWERS)}) as heading, {test(P.POINTS_AT_MATERIAL)} as points from x left join y on y.paper_id = x.paper_id and y.k = x.k),
s as (
  select paper_id, 0::bigint as k, false as started, false as opened, '' as previous, '' as role from f group by 1
  union all
  select paper_id, k, started or role = 'question_start', case when role in ('question_start', 'section_header') then false else opened or pointed end, case when role in ('section_header', 'instruction', 'furniture', 'material') then '' else role end, role from (
    select *, points and first_role in ('instruction', 'furniture', 'question_continuation') as pointed, case when points and first_role in ('instruction', 'furniture', 'question_continuation') then 'instruction' else first_role end as role from (
      select f.paper_id, f.k, s.started, s.opened, f.points, case when f.plain = '' then 'furniture' when s.opened and not header and not rubric and not label then 'material' when quote then 'material' when header then 'section_header'
        when only_marks then 'marks' when page_number then 'furniture' when rubric or per then 'instruction' when aside then 'furniture'
        when label then case when not has_body then 'furniture' when s.started or numbered then 'question_start' else 'instruction' end
        when heading then 'instruction' when s.previous in ('question_start', 'question_continuation', 'stem') then 'question_continuation' else 'furniture' end as first_role
      from s join f on f.paper_id = s.paper_id and f.k = s.k + 1)))
select f.paper_id, f.ord, s.role, f.text from s join f on f.paper_id = s.paper_id and f.k = s.k"""


@query(_classified_sql())
def classify_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.classify_papers(V.paper_lines(spark, sf_dir))


_L = V.LINES


@query(f"""with {_L}, b as (select item_id, lower(text) as t from benchmark),
g as (select item_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) as term from b), q as (select distinct item_id, term from g where length(term) > 2), n as (select item_id, count(*) as n from q group by 1),
p as (select distinct doc_id, ord, term from (select doc_id, ord, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from lines) where length(term) > 2),
s as (select item_id, doc_id, ord, round(count(*) / any_value(n)::double, 6) as score from p join q using (term) join n using (item_id) group by 1, 2, 3),
x as (select item_id, max(score) as score, arg_max(struct_pack(d := doc_id, o := ord), (score, -doc_id, -ord)) as w from s group by 1)
select item_id, score, w.d as doc_id, w.o as ord, case when score >= 0.65 then 'met' when score <= 0.25 then 'not_met' else 'deferred' end as verdict from x""")
def premise_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that supports each item best by word coverage, and the verdict by its score."""
    terms = lambda c: F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))).alias("term")
    q = V.table(spark, sf_dir, "benchmark").select("item_id", terms("text")).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    p = V.lines(spark, sf_dir).select("doc_id", "ord", terms("line"))
    s = p.join(q, "term").groupBy("item_id", "doc_id", "ord").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    best = s.groupBy("item_id").agg(F.max(F.struct("score", -F.col("doc_id"), -F.col("ord"))).alias("b")).select("item_id", "b.score", (-F.col("b.col2")).alias("doc_id"), (-F.col("b.col3")).alias("ord"))
    return best.select("item_id", "score", "doc_id", "ord", F.when(F.col("score") >= 0.65, "met").when(F.col("score") <= 0.25, "not_met").otherwise("deferred").alias("verdict"))
