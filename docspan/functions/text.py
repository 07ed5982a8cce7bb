"""Scalar text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions import patterns as P


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def extracted(text: Column, pattern: str, group: int) -> Column:
    """A regex group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_marks(text: Column) -> Column:
    """Trailing mark allocation as int, null if none."""
    return extracted(text, P.MARKS, 1).cast("int")


def per_question_marks(text: Column) -> Column:
    return F.coalesce(extracted(text, P.PER_QUESTION_MARKS, 1), extracted(text, P.MARKS_EACH, 1)).cast("int")


def parse_count(text: Column) -> Column:
    """The number of an "any N" clause, in digits or words."""
    raw = F.lower(extracted(text, P.ANY_COUNT, 1))
    words = F.array_position(F.array(*map(F.lit, P.NUMBER_WORDS)), raw).cast("int")
    return F.when(raw.rlike("^[0-9]+$"), F.try_to_number(raw, F.lit("99")).cast("int")).otherwise(F.nullif(words, F.lit(0)))


def section_label(text: Column) -> Column:
    return F.upper(extracted(text, P.SECTION_HEADER, 1))


def named_section(text: Column) -> Column:
    return F.upper(extracted(text, P.NAMED_SECTION, 1))


def reads_as_a_heading(text: Column) -> Column:
    return matches(text, P.POINTS_AT_ITS_PARTS) & (F.rtrim(text).endswith(":") | matches(text, P.INVITES_ANSWERS))


def found_injection(text: Column) -> Column:
    return F.trim(extracted(text, P.INJECTION_PATTERN, 0))


def evidence_kind(text: Column) -> Column:
    """Kind of evidence that a question asks for: drawing first, then verb families in order, else RECALL."""
    kind = F.when(matches(text, P.DRAWING), "DRAWING")
    for name, verbs in P.EVIDENCE_VERBS:
        kind = kind.when(matches(text, verb_pattern(verbs)), name)
    return kind.otherwise("RECALL")


def verb_pattern(verbs: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(verbs) + r")\b"


def mentions_continuation(text: Column) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for marker in P.CONTINUATION_MARKERS:
        hit = hit | lowered.contains(marker)
    return hit


def label_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normalise_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def tokens(text: Column) -> Column:
    """Content words: [a-z0-9]+ of two or more characters that are not stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(P.STOPWORDS))


def trigrams(text: Column) -> Column:
    """3-grams of the lower-cased ASCII letters and digits; the whole string if it is shorter."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    grams = F.regexp_extract_all(s, F.lit("(?=(...))"), F.lit(1))  # a look-ahead matches at every place, in one pass
    return F.when(F.length(s) >= 3, grams).when(F.length(s) > 0, F.array(s)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))


def length_plausibility(words: Column, marks: Column) -> Column:
    """min / max of the words written and those expected of the marks (12 a mark, 6 at least)."""
    expected = F.greatest(F.lit(6), marks * 12)
    return F.least(words, expected) / F.greatest(words, expected)


def redact(text: Column) -> Column:
    """Credentials cut to their first six characters, with assigned secrets and addresses masked too."""
    out = text
    for pattern in P.CREDENTIALS:
        out = F.regexp_replace(out, pattern, "$1...[redacted]")
    out = F.regexp_replace(out, P.ASSIGNED, "$1$2$3...[redacted]")
    return F.regexp_replace(out, P.ADDRESS, "***@***")
