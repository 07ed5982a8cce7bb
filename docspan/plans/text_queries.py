"""Scalar, classifier and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.functions import patterns as P
from docspan.functions import text as X
from docspan.operators import labels
from docspan.plans import views as V
from docspan.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _number_word(raw: str) -> str:
    return "case " + " ".join(f"when {raw} = '{w}' then {i + 1}" for i, w in enumerate(P.NUMBER_WORDS)) + " end"


_COUNT = f"lower(nullif(regexp_extract(text, {q(P.ANY_COUNT)}, 1), ''))"


@query(V.with_(V.PAPER_LINES, body=f"""
select paper_id, ord, try_cast(nullif(regexp_extract(text, {q(P.MARKS)}, 1), '') as integer) as marks,
  cast(coalesce(nullif(regexp_extract(text, {q(P.PER_QUESTION_MARKS)}, 1), ''), nullif(regexp_extract(text, {q(P.MARKS_EACH)}, 1), '')) as integer) as per_question,
  cast(coalesce(try_cast({_COUNT} as integer), {_number_word(_COUNT)}) as integer) as any_count,
  upper(nullif(regexp_extract(text, {q(P.SECTION_HEADER)}, 1), '')) as section,
  upper(nullif(regexp_extract(text, {q(P.NAMED_SECTION)}, 1), '')) as named_section,
  regexp_matches(text, {q(P.ALL_REQUIRED)}) as all_required
from paper_lines"""))  # fmt: skip
def label_section_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return V.paper_lines(spark, sf_dir).select(
        "paper_id", "ord", X.extract_marks(t).alias("marks"), X.per_question_marks(t).alias("per_question"), X.parse_count(t).alias("any_count"),
        X.section_label(t).alias("section"), X.named_section(t).alias("named_section"), X.matches(t, P.ALL_REQUIRED).alias("all_required"),
    )


def label_sql(view: str) -> str:
    """The label of every line of a view that has one; the view has text, and prefixes from the letters of its paper."""
    group = lambda c, p: f"nullif(regexp_extract({c}, {q(p)}, 1), '')"
    return f"""
seen as (select paper_id, regexp_extract(trim(text), {q(labels.SECTION_LETTER)}, 1) as letter, count(distinct try_cast(regexp_extract(trim(text), '^[A-Z]\\s?(\\d{{1,3}})\\b', 1) as integer)) as n from {view} group by 1, 2),
label_a as (select *, translate(text, '{labels.FROM}', '{labels.TO}') as plain from {view}),
label_b as (select a.*, {group("plain", P.QUESTION_LEAD)} as question, s.letter as letter from label_a a left join seen s on a.paper_id = s.paper_id and s.n >= 3 and s.letter <> '' and s.letter = regexp_extract(plain, {q(labels.SECTION_LETTER)}, 1)),
label_c as (select *, case when question is null then letter end as section, coalesce(question, case when letter is not null then {group("plain", labels.SECTION_REST)} end) as lead from label_b),
label_d as (select *, coalesce(lead, regexp_replace(plain, '^\\s+', '')) as body from label_c),
label_e as (select *, case when lead is not null then {group("body", labels.AFTER_LEAD)} else coalesce({group("body", labels.WITH_ELEMENT)}, {group("body", labels.WITH_NUMBER)}, {group("body", labels.WITH_BRACKET)}) end as found from label_d),
label_f as (select *, length(plain) - length(body) + length(found) as stop, regexp_extract_all(found, {q(P.LABEL_TOKEN)}) as tokens from label_e where found is not null),
parsed as (select paper_id, ord, trim(regexp_replace(substr(text, 1, stop), '\\s+', ' ', 'g')) as raw, tokens, section, regexp_replace(substr(text, stop + 1), '^\\s+|\\s+$', '', 'g') as remainder,
  case when found like '(%' then 'parenthesised' when lead is not null or regexp_matches(tokens[1], '^[0-9]') then 'numeric' else 'trailing_punct' end as style
  from label_f where substr(plain, stop + 1, 1) = '' or regexp_matches(substr(plain, stop + 1, 1), '^\\s'))"""


def _labels(lines: DataFrame) -> DataFrame:
    known = lines.join(labels.section_prefixes(lines, "paper_id", "text"), "paper_id", "left")
    found = known.withColumn("label", labels.label_of(F.col("text"), F.coalesce("prefixes", F.array().cast("array<string>")))).where("label is not null")
    return found.select("paper_id", "ord", "label.*")


@query("with " + V.LABELLED_LINES + "," + label_sql("labelled_lines") + " select paper_id, ord, raw, array_to_string(tokens, ',') as tokens, style, section, remainder from parsed")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every form, with the section letters that each paper is seen to use."""
    return _labels(V.labelled_lines(spark, sf_dir)).withColumn("tokens", F.array_join("tokens", ","))


@query("with " + V.LABELLED_LINES + "," + label_sql("labelled_lines") + " select paper_id, array_to_string(list_concat(case when section is null then [] else [section] end, tokens), '/') as qid, count(*) as times, min(ord) as first_ord, max(length(remainder)) >= 3 as has_text from parsed group by 1, 2")
def canonical_qids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of a paper's labels, how often each comes, and whether some line of it carries a question."""
    found = _labels(V.labelled_lines(spark, sf_dir)).withColumn("qid", labels.canonical_qid(F.col("section"), F.col("tokens")))
    return found.groupBy("paper_id", "qid").agg(F.count("*").alias("times"), F.min("ord").alias("first_ord"), (F.max(F.length("remainder")) >= 3).alias("has_text"))


@query(V.with_(V.PAPER_LINES, body=f"""
select paper_id, min(ord) as first_ord, arg_min(trim(regexp_extract(text, {q(P.INJECTION_PATTERN)}, 0)), ord) as phrase
from paper_lines where regexp_matches(text, {q(P.INJECTION_PATTERN)}) group by paper_id"""))  # fmt: skip
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrase of each paper that is addressed to the marker."""
    hits = V.paper_lines(spark, sf_dir).withColumn("phrase", X.found_injection(F.col("text"))).where("phrase is not null")
    return hits.groupBy("paper_id").agg(F.min("ord").alias("first_ord"), F.min_by("phrase", "ord").alias("phrase"))


@query(V.with_(V.PAPER_LINES, body=f"""
select paper_id, ord, regexp_matches(text, {q(P.IDENTITY_FIELD)}) as identity,
  (ord / 40.0::double <= 0.12 or ord / 40.0::double >= 0.88) and regexp_matches(text, {q(P.SHEET_PAGE_NUMBER)}) as page_number,
  ord / 40.0::double <= 0.12 and (regexp_matches(text, {q(P.PAPER_SET)}) or regexp_matches(text, {q(P.LONG_NUMBER)}) or regexp_matches(text, {q(P.BARE_NAME)})) as header_detail
from paper_lines"""))  # fmt: skip
def furniture_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details about the script: fields anywhere, page numbers at the edges, set, number and name in the header band."""
    t, y = F.col("text"), F.col("ord") / F.lit(40.0)
    return V.paper_lines(spark, sf_dir).select(
        "paper_id", "ord", X.matches(t, P.IDENTITY_FIELD).alias("identity"), (((y <= 0.12) | (y >= 0.88)) & X.matches(t, P.SHEET_PAGE_NUMBER)).alias("page_number"),
        ((y <= 0.12) & (X.matches(t, P.PAPER_SET) | X.matches(t, P.LONG_NUMBER) | X.matches(t, P.BARE_NAME))).alias("header_detail"),
    )


_KIND = f"case when regexp_matches(text, {q(P.DRAWING)}) then 'DRAWING' " + " ".join(f"when regexp_matches(text, {q(X.verb_pattern(v))}) then '{k}'" for k, v in P.EVIDENCE_VERBS) + " else 'RECALL' end"


@query(V.with_(V.PAPER_LINES, body=f"select paper_id, ord, {_KIND} as kind, {_KIND} = 'DRAWING' as expects_a_drawing from paper_lines"))
def evidence_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = X.evidence_kind(F.col("text"))
    return V.paper_lines(spark, sf_dir).select("paper_id", "ord", kind.alias("kind"), (kind == "DRAWING").alias("expects_a_drawing"))


@query(V.with_(V.PAPER_LINES, body=f"""
select paper_id, ord, regexp_matches(text, {q(P.POINTS_AT_MATERIAL)}) as points_at, regexp_matches(text, {q(P.REFERS_TO_MATERIAL)}) as refers_to,
  regexp_matches(text, {q(P.POINTS_AT_ITS_PARTS)}) and (rtrim(text) like '%:' or regexp_matches(text, {q(P.INVITES_ANSWERS)})) as heading,
  regexp_matches(text, {q(P.ONLY_MARKS)}) as only_marks, regexp_matches(text, {q(P.BRACKETED_ASIDE)}) as aside, regexp_matches(text, {q(P.PAGE_MARKER)}) as page_marker
from paper_lines"""))  # fmt: skip
def material_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return V.paper_lines(spark, sf_dir).select(
        "paper_id", "ord", X.matches(t, P.POINTS_AT_MATERIAL).alias("points_at"), X.matches(t, P.REFERS_TO_MATERIAL).alias("refers_to"), X.reads_as_a_heading(t).alias("heading"),
        X.matches(t, P.ONLY_MARKS).alias("only_marks"), X.matches(t, P.BRACKETED_ASIDE).alias("aside"), X.matches(t, P.PAGE_MARKER).alias("page_marker"),
    )


def _redacted_sql() -> str:
    out = "text"
    for pattern in P.CREDENTIALS:
        out = f"regexp_replace({out}, {q(pattern)}, '\\1...[redacted]', 'g')"
    out = f"regexp_replace({out}, {q(P.ASSIGNED)}, '\\1\\2\\3...[redacted]', 'g')"
    return f"regexp_replace({out}, {q(P.ADDRESS)}, '***@***', 'g')"


@query(f"select doc_id, len(string_split(red, '[redacted]')) - 1 as n_masked, len(string_split(red, '***@***')) - 1 as n_addresses, md5(red) as redacted_md5 from (select doc_id, {_redacted_sql()} as red from documents)")
def secrets_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = V.table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text")).alias("red"))
    count = lambda mark: (F.size(F.split("red", mark)) - 1).cast("long")
    return red.select("doc_id", count(r"\[redacted\]").alias("n_masked"), count(r"\*\*\*@\*\*\*").alias("n_addresses"), F.md5("red").alias("redacted_md5"))


_CONT = "(" + " or ".join(f"contains(lower(text), '{m}')" for m in P.CONTINUATION_MARKERS) + ")"


@query(f"select conv_id, turn, {_CONT} as continues from conversations")
def continuation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.mentions_continuation(F.col("text")).alias("continues"))


@query("""
select doc_id, 'empty' as problem from documents where length(trim(text)) = 0
union all select doc_id, 'long' from documents where length(text) > 1200
union all select doc_id, 'duplicate' from (select doc_id, count(*) over (partition by sha256(text)) as n from documents) where n > 1""")
def suspicious_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem rows: empty, over-long and duplicate texts. Duplicates meet by hash, counted partially before the shuffle."""
    docs = V.table(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    twice = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = lambda df, name: df.select("doc_id", F.lit(name).alias("problem"))
    return rows(docs.where(F.length(F.trim("text")) == 0), "empty").unionAll(rows(docs.where(F.length("text") > 1200), "long")).unionAll(rows(hashed.join(twice, "h", "left_semi"), "duplicate"))


@query("select sha256(text) as content_hash, min(doc_id) as first_id, count(*) as copies from documents group by 1")
def text_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writer of each content hash."""
    return V.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)


@query(f"""
select item_id, tok, count(*) as tf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from benchmark)
where length(tok) > 1 and tok not in ({_STOP}) group by 1, 2""")
def tokens_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("tok")).groupBy("item_id", "tok").agg(F.count("*").alias("tf"))


@query("""
with s as (select item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as s from benchmark)
select item_id, gram, count(*) as tf from (select item_id, unnest([substr(s, i, 3) for i in range(1, greatest(length(s) - 2, 1) + 1)]) as gram from s where length(s) > 0) group by 1, 2""")
def trigram_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.trigrams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("tf"))


@query(V.with_(V.LINES, body="""
, r as (select doc_id, ord, length(line) + length(cast(ord as varchar)) + 4 as n, sum(length(line) + length(cast(ord as varchar)) + 4) over (partition by doc_id order by ord) as upto from lines)
select doc_id, cast(count(*) filter (where upto <= 600) as bigint) as kept, cast(coalesce(sum(n) filter (where upto <= 600), 0) as bigint) as chars, max(upto) > 600 as truncated from r group by 1"""))
def numbered_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"[ord] line" rows within a budget of 600 characters. A window over one document's lines."""
    n = (F.length("line") + F.length(F.col("ord").cast("string")) + 4).alias("n")
    rows = V.lines(spark, sf_dir).select("doc_id", "ord", n).withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= 600
    return rows.groupBy("doc_id").agg(F.count_if(fits).alias("kept"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).cast("long").alias("chars"), (F.max("upto") > 600).alias("truncated"))


@query("""
select doc_id, words, round(least(words, e) / greatest(words, e)::double, 6) as plausibility, words >= 1.4 * e as may_share from (
  select d.doc_id, cast(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as integer) as words, greatest(6, 12 * (1 + l.quality * 4)) as e from documents d join labels l using (doc_id))""")
def length_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written against words expected of the marks (1 or 5, by quality)."""
    marks = 1 + F.col("quality") * 4
    joined = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", X.word_count(F.col("text")).alias("words"), marks.alias("m"))
    expected = F.greatest(F.lit(6), F.col("m") * 12)
    return joined.select("doc_id", "words", F.round(X.length_plausibility(F.col("words"), F.col("m")), 6).alias("plausibility"), (F.col("words") >= 1.4 * expected).alias("may_share"))


@query("""
with p as (select p_partkey, 2 + p_size % 5 as avail, 1 + p_partkey % 4 as n from part),
k as (select *, case when n >= 2 and avail / n::double >= 0.5 then n else 1 end as parts from p),
e as (select *, round_even(avail / parts::double * 2, 0) / 2 as each from k)
select p_partkey, i as criterion, case when i = 1 then each + avail - each * parts else each end as marks from (select *, unnest(range(1, parts + 1)) as i from e)""")
def rubric_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in half-mark criteria, the rest on the first."""
    p = V.table(spark, sf_dir, "part").selectExpr("p_partkey", "2 + p_size % 5 as avail", "1 + p_partkey % 4 as n")
    k = p.withColumn("parts", F.when((F.col("n") >= 2) & (F.col("avail") / F.col("n") >= 0.5), F.col("n")).otherwise(F.lit(1).cast("long")))
    e = k.withColumn("each", F.bround(F.col("avail") / F.col("parts") * 2, 0) / 2).withColumn("criterion", F.explode(F.expr("sequence(1L, parts)")))
    return e.select("p_partkey", "criterion", F.when(F.col("criterion") == 1, F.col("each") + F.col("avail") - F.col("each") * F.col("parts")).otherwise(F.col("each")).alias("marks"))


@query(V.with_(V.SUB_LINES, body="""
, t as (select l_orderkey, ord, l_quantity, sum(l_quantity) over (partition by l_orderkey) as total from sub_lines),
r as (select *, greatest(round_even(l_quantity / total * 10 * 2, 0) / 2, 0.5::double) as part from t)
select l_orderkey, ord, case when ord = 1 then part + 10 - sum(part) over (partition by l_orderkey) else part end as marks from r"""))
def checks_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check marks rescaled to ten in half marks, at least half a mark each, the rest on the first."""
    w = Window.partitionBy("l_orderkey")
    r = V.sub_lines(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("share"))
    r = r.withColumn("part", F.greatest(F.bround(F.col("share") * 10 * 2, 0) / 2, F.lit(0.5)))
    return r.select("l_orderkey", "ord", F.when(F.col("ord") == 1, F.col("part") + 10 - F.sum("part").over(w)).otherwise(F.col("part")).alias("marks"))


@query("""
with n as (select p_partkey, p_brand, p_name, row_number() over (partition by p_brand order by p_partkey) as k from part)
select a.p_partkey as truth_id, b.p_partkey as predicted_id, cast(levenshtein(a.p_name, b.p_name) as integer) as distance, round(levenshtein(a.p_name, b.p_name) / length(a.p_name)::double, 6) as cer
from n a join n b on a.p_brand = b.p_brand and b.k = a.k + 1""")
def cer_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each name against the next one of its brand."""
    after = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("truth_id"), "p_name", F.lead("p_partkey").over(after).alias("predicted_id"), F.lead("p_name").over(after).alias("other")).where("predicted_id is not null")
    d = F.levenshtein("p_name", "other")
    return p.select("truth_id", "predicted_id", d.alias("distance"), F.round(d / F.length("p_name"), 6).alias("cer"))


@query(V.with_(V.LINES, body="""select regexp_replace(lower(line), '[^a-z0-9]', '', 'g') as label_key, count(*) as n, count(distinct trim(regexp_replace(line, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as spellings
from lines where length(line) <= 24 group by 1"""))
def label_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines by label key, and how many ways each is written."""
    short = V.lines(spark, sf_dir).where(F.length("line") <= 24)
    return short.groupBy(X.label_key(F.col("line")).alias("label_key")).agg(F.count("*").alias("n"), F.count_distinct(X.normalise_spaces(F.col("line"))).alias("spellings"))


@query(f"""
with c as (select p.paper_id, p.ord, i, trim(unnest(string_split_regex(text, '(?i)\\band\\b'))) as text from (select paper_id, ord, text, 0 as i from paper_lines) p),
r as (select paper_id, ord, cast(coalesce(try_cast({_COUNT} as integer), {_number_word(_COUNT)}) as integer) as answer_any, regexp_matches(text, {q(P.ALL_REQUIRED)}) as everything,
  coalesce(upper(nullif(regexp_extract(text, {q(P.NAMED_SECTION)}, 1), '')), '') as section from c)
select paper_id, section, arg_max(coalesce(answer_any, -1), ord) as answer_any from r where answer_any is not null or everything group by 1, 2""".replace("with c", f"with {V.PAPER_LINES}, c", 1))
def requirement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on how many questions to answer, by section; the last statement wins, -1 means all."""
    c = V.paper_lines(spark, sf_dir).select("paper_id", "ord", F.explode(F.split("text", r"(?i)\band\b")).alias("clause"))
    t = F.col("clause")
    r = c.select("paper_id", "ord", X.parse_count(t).alias("n"), X.matches(t, P.ALL_REQUIRED).alias("everything"), F.coalesce(X.named_section(t), F.lit("")).alias("section"))
    r = r.where("n is not null or everything")
    return r.groupBy("paper_id", "section").agg(F.max_by(F.coalesce("n", F.lit(-1)), "ord").alias("answer_any"))


_TAGS = "regexp_replace({}, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"


@query(f"""
with l as (select page_id, unnest(string_split(regexp_replace({_TAGS.format('html')}, '<[^>]*>', chr(10), 'g'), chr(10))) as line from pages)
select page_id, count(*) as n_lines, cast(sum(length(trim(line))) as bigint) as n_chars from l where length(trim(line)) > 0 group by 1""")
def text_layer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of each page, markup taken off."""
    html = F.regexp_replace("html", "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    lines = V.table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n")).alias("line"))
    return lines.where(F.length(F.trim("line")) > 0).groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.length(F.trim("line"))).alias("n_chars"))


@query(f"select page_id, cast(length(html) - length({_TAGS.format('html')}) as integer) as hidden_chars, cast(len(regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>')) as integer) as hidden_spans from pages")
def hidden_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>"
    kept = F.regexp_replace("html", pattern, "")
    return V.table(spark, sf_dir, "pages").select("page_id", (F.length("html") - F.length(kept)).alias("hidden_chars"), F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("hidden_spans"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_k, max(cast(json_extract_string(props, '$.k') as bigint)) as max_k from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return V.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@query(V.with_(V.LINES, body="""
, w as (select doc_id, ord, line, lead(line) over (partition by doc_id order by ord) as after from lines)
select doc_id, ord, 1 as width, length(line) as chars from w union all select doc_id, ord, 2, length(line || ' ' || after) from w where after is not null"""))
def premises_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one- and two-line window of a document."""
    w = V.lines(spark, sf_dir).withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("ord")))
    one = w.select("doc_id", "ord", F.lit(1).alias("width"), F.length("line").cast("long").alias("chars"))
    return one.unionAll(w.where("after is not null").select("doc_id", "ord", F.lit(2), (F.length("line") + 1 + F.length("after")).cast("long")))


@query("""select doc_id, i as ord, sentence, least(0.05 + 0.04 * (i - 1), 0.90)::double as y0 from (
  select doc_id, unnest(range(1, len(string_split(text, '. ')) + 1)) as i, unnest(string_split(text, '. ')) as sentence from documents)""")
def synthetic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as lines at ". ", with boxes down the page."""
    s = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")))
    return s.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), F.col("col").alias("sentence"), F.least(F.expr("cast(0.05BD + 0.04BD * pos as double)"), F.lit(0.90)).alias("y0"))
