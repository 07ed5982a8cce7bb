"""Gates and small rules of alignment, marking and review, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions import geometry as G
from docspan.functions import patterns as P
from docspan.functions.text import evidence_kind, matches

LOW_CONFIDENCE, LOW_SHARE = 0.60, 0.50
UNSURE_MAPPING, UNSURE_GRADE = 0.55, 0.6
TAIL_GAP, TAIL_TOP = 0.12, 0.25
ROW_OVERLAP, ROW_GAP = 0.5, 0.08
BAND_GAP, BAND_WIDTH = 1.2, 0.15
REREAD = ("WORKING", "SYMBOLIC", "DRAWING")
MAX_FIELD = 300

#: Phrases of warnings, by how loudly they are shown.
BLOCKING = ("were not marked", "not marked automatically", "none of the writing", "no questions were extracted", "could not be located", "nothing was transcribed")
DEGRADED = (
    "rather than by meaning", "less reliable", "could not be read", "could not be matched", "no question is reported as unanswered", "appears to be missing", "page may be missing",
    "multiple columns", "straightened before reading",
)
#: Fixed value: facts about a quota that a trimmed message keeps.
QUOTA = r"(?i)(quota[A-Za-z]*\s*[:=]\s*\S+|limit:?\s*\d+|Limit \d+|Used \d+|per (?:day|minute)|TP[DM]|RP[DM]|retry in [\d.ms]+|try again in [\d.ms]+)"


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    lowered, found = F.lower(text), F.lit(False)
    for p in phrases:
        found = found | lowered.contains(p)
    return found


def severity(warning: Column) -> Column:
    """blocking, degraded or informational."""
    return F.when(any_phrase(warning, BLOCKING), "blocking").when(any_phrase(warning, DEGRADED), "degraded").otherwise("informational")


def expects_drawing(question: Column) -> Column:
    return matches(question, P.DRAWING)


def has_text(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def text_free_plausible(question: Column, text: Column, hint: Column) -> Column:
    """A block without text fits only a question that asks for a drawing, or one that a label points at."""
    return has_text(text) | (hint > 0) | expects_drawing(question)


def may_continue(question: Column, text: Column, goes_on: Column) -> Column:
    """Whether an answer can carry on into a block."""
    return has_text(text) | goes_on | expects_drawing(question)


def _parent(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def _leads(shorter: Column, longer: Column) -> Column:
    return F.slice(longer, F.lit(1), F.size(shorter)) == shorter


def may_share(owner: Column, candidate: Column, text: Column) -> Column:
    """Whether a block with text may answer both questions: siblings, or one path leads the other."""
    return has_text(text) & ((_parent(owner) == _parent(candidate)) | _leads(owner, candidate) | _leads(candidate, owner))


def parts_of_one(owner: Column, candidate: Column, text: Column) -> Column:
    """Parts of one numbered question: siblings below the top, or a part and its question."""
    siblings = (F.size(owner) > 1) & (_parent(owner) == _parent(candidate))
    above = ((F.size(owner) < F.size(candidate)) & _leads(owner, candidate)) | ((F.size(candidate) < F.size(owner)) & _leads(candidate, owner))
    return has_text(text) & (F.greatest(F.size(owner), F.size(candidate)) > 1) & (siblings | above)


def runs_on(end_page: Column, end_y1: Column, page: Column, y0: Column) -> Column:
    """Whether a block starts where the rest of the one above would."""
    return F.when(page == end_page, y0 - end_y1 <= TAIL_GAP).when(page == end_page + 1, y0 <= TAIL_TOP).otherwise(False)


def same_row(a: G.Box, b: G.Box) -> Column:
    """Level boxes with a small gap between them."""
    gap = F.greatest(a[0], b[0]) - F.least(a[2], b[2])
    return (G.vertical_overlap(a, b) >= ROW_OVERLAP) & (gap <= ROW_GAP)


def joins(upper: G.Box, lower: G.Box) -> Column:
    """Whether a line continues the band above: a gap of 1.2 line heights at most and a shared width."""
    height = F.greatest(upper[3] - upper[1], lower[3] - lower[1])
    shared = F.least(upper[2], lower[2]) - F.greatest(upper[0], lower[0])
    narrower = F.least(upper[2] - upper[0], lower[2] - lower[0])
    return (lower[1] - upper[3] <= height * BAND_GAP) & (shared > 0) & (shared / narrower >= BAND_WIDTH)


def touches(upper: G.Box, lower: G.Box) -> Column:
    """A shared edge and some shared width."""
    return (F.abs(lower[1] - upper[3]) <= 1e-6) & (F.least(upper[2], lower[2]) > F.greatest(upper[0], lower[0]))


def worth_rereading(question: Column, low: Column, lines: Column) -> Column:
    """Answers that recognition is likely to have damaged, by the question's kind or the share of unsure lines."""
    return (lines > 0) & (evidence_kind(question).isin(*REREAD) | (low / lines >= LOW_SHARE))


def cited_share(awarded: Column, cited: Column, unevidenced: Column) -> Column:
    """Confidence by the share of awarded points that cite lines; half at most where credit came without evidence."""
    share = F.when(awarded == 0, F.lit(0.8)).otherwise(F.bround(0.5 + 0.5 * cited / awarded, 2))
    return F.when(unevidenced > 0, F.least(share, F.lit(0.5))).otherwise(share)


def position_key(qid: Column) -> Column:
    """A number that sorts question ids by the numbers in their first four parts."""
    parts = F.split(qid, "/")
    weight = F.transform(parts, lambda p, i: F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint") * F.pow(F.lit(1000.0), 3 - F.least(i, F.lit(3))).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(weight, F.lit(0).cast("bigint"), lambda s, v: s + v)


def split_label(raw: Column, path: Column) -> Column:
    """struct<badge, sub> of a printed label; a bare part takes its number from the path."""
    text = F.trim(raw)
    numbered = r"^(\d+)\s*[.)]?\s*(?:\(\s*([A-Za-z]+)\s*\)|([A-Za-z]+)[.)])?\s*$"
    bare = r"^\(?\s*([A-Za-z0-9]{1,4})\s*\)?\s*[.)]?$"
    letter = F.coalesce(F.nullif(F.regexp_extract(text, numbered, 2), F.lit("")), F.nullif(F.regexp_extract(text, numbered, 3), F.lit("")))
    token = F.regexp_extract(text, bare, 1)
    short = F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", ""), 1, 3)
    below = F.size(path) > 1
    badge = F.when(matches(text, numbered), F.regexp_extract(text, numbered, 1)).when(matches(text, bare), F.when(below, F.get(path, F.lit(0))).otherwise(token)).otherwise(F.when(short == "", "?").otherwise(short))
    sub = F.when(matches(text, numbered), F.concat(letter, F.lit("."))).when(matches(text, bare) & below, F.concat(token, F.lit(".")))
    return F.struct(badge.alias("badge"), sub.alias("sub"))


def redact(text: Column) -> Column:
    """Credentials cut to their first six characters."""
    return F.regexp_replace(text, "|".join(P.CREDENTIALS), "$1$2$3...[redacted]")


def trim_message(text: Column) -> Column:
    """At most MAX_FIELD characters, with the quota facts that a cut would lose behind them."""
    kept = F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(QUOTA), F.lit(1))), " ")
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), MAX_FIELD - F.length(kept) - 5))
    told = F.substring(F.concat(head, F.lit(" ... "), kept), F.lit(1), MAX_FIELD + F.length(kept) + 5)
    return F.when(F.length(text) <= MAX_FIELD, text).when(kept == "", F.substring(text, 1, MAX_FIELD)).otherwise(told)


def character_error_rate(truth: Column, predicted: Column) -> Column:
    """Edit distance over the truth's length; with no truth 0 if nothing was read, else 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, predicted) / F.length(truth))


def criterion_lines(criteria: Column) -> Column:
    """Numbered rubric text. criteria: array<struct<marks, criterion, note>>."""
    line = lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), c["marks"].cast("string"), F.when(c["marks"] == 1, " mark] ").otherwise(" marks] "), c["criterion"], F.lit("\n     "), c["note"])
    return F.array_join(F.transform(criteria, line), "\n")


def padded_citation(line_id: Column, known: Column) -> Column:
    """The known line that a citation means: itself, or the only one of its prefix with the same number."""
    prefix, tail = F.regexp_extract(line_id, r"^(.*):([0-9]+)$", 1), F.regexp_extract(line_id, r"^(.*):([0-9]+)$", 2)
    same = F.filter(known, lambda k: (F.regexp_extract(k, r"^(.*):([0-9]+)$", 1) == prefix) & (F.regexp_extract(k, r"^(.*):([0-9]+)$", 2).try_cast("bigint") == tail.try_cast("bigint")))
    return F.when(F.array_contains(known, line_id) | (tail == "") | (F.size(same) != 1), line_id).otherwise(F.get(same, F.lit(0)))
