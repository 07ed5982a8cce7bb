"""The label grammar of question papers, as Column expressions and for ordered folds.

A label is a chain of elements at the start of a line: a token in brackets, a token with a point or bracket behind it,
or, in first place only, a bare number that something bears out (a Q or a section letter in front, or a bracket or
another element behind). It ends at white space or with the line. Accents are taken off before matching, character for
character, so places found in the plain text hold in the original.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions import patterns as P

BRACKETED = rf"\(\s*{P.LABEL_TOKEN}[\s.]*\)"
POINTED = rf"{P.LABEL_TOKEN}\x20*[.)]"
ELEMENT = f"(?:{BRACKETED}|{POINTED})"
#: A whole label, by how it starts: with an element, with a number and an element, with a number and a bracket, after a lead.
WITH_ELEMENT = rf"^({ELEMENT}(?:\x20*{ELEMENT})*)"
WITH_NUMBER = rf"^(\d{{1,3}}(?:\x20*{ELEMENT})+)"
WITH_BRACKET = r"^(\d{1,3})\x20*[(\[]"
AFTER_LEAD = rf"^((?:{BRACKETED}|{POINTED}|\d{{1,3}})(?:\x20*{ELEMENT})*)"
SECTION_LETTER = r"^\s*([A-Z])\s?\d{1,3}\b"
SECTION_REST = r"(?s)^\s*[A-Z]\s?(\d{1,3}\b.*)$"
MIN_PREFIX_USES = 3  # different numbers behind a letter that make it a section's


def _plain_letters() -> dict[int, str]:
    """The ASCII letter or digit that each other character starts with when it is taken apart."""
    table = {}
    for code in range(128, sys.maxunicode + 1):
        first = unicodedata.normalize("NFKD", chr(code))[:1] if not 0xD800 <= code < 0xE000 else ""
        if first.isascii() and first.isalnum():
            table[code] = first
    return table


PLAIN = _plain_letters()
_BASIC = {c: to for c, to in PLAIN.items() if c < 0x10000}  # a Column's translate works on these
FROM, TO = "".join(map(chr, _BASIC)), "".join(_BASIC.values())


@dataclass(frozen=True)
class Label:
    raw: str
    tokens: tuple[str, ...]
    remainder: str
    style: str = ""
    section: str | None = None


def deaccent(text: str) -> str:
    """Each character by its ASCII letter or digit where it has one; the length stays."""
    return text.translate(PLAIN)


_PARSERS = {name: re.compile(p) for name, p in (("element", WITH_ELEMENT), ("number", WITH_NUMBER), ("bracket", WITH_BRACKET), ("lead", AFTER_LEAD), ("question", P.QUESTION_LEAD), ("letter", SECTION_LETTER), ("rest", SECTION_REST), ("token", P.LABEL_TOKEN))}


def parse_label(text: str, prefixes: frozenset[str] = frozenset()) -> Label | None:
    """The label that a line opens with, or None. prefixes: letters that the paper numbers its sections with."""
    plain, section = deaccent(text), None
    lead = _PARSERS["question"].search(plain)
    if not lead and (letter := _PARSERS["letter"].search(plain)) and letter[1] in prefixes:
        lead, section = _PARSERS["rest"].search(plain), letter[1]
    body = lead[1] if lead else plain.lstrip()
    found = next((m for name in (("lead",) if lead else ("element", "number", "bracket")) if (m := _PARSERS[name].search(body))), None)
    if not found:
        return None
    stop = len(plain) - len(body) + found.end(1)
    if stop < len(plain) and not plain[stop].isspace():
        return None
    tokens = tuple(_PARSERS["token"].findall(found[1]))
    style = "parenthesised" if found[1].startswith("(") else "numeric" if lead or tokens[0].isdigit() else "trailing_punct"
    return Label(" ".join(text[:stop].split()), tokens, text[stop:].strip(), style, section)


def label_of(text: Column, prefixes: Column | None = None) -> Column:
    """struct<raw, tokens, style, section, remainder>, null where a line has no label. prefixes: an array of section letters."""
    plain = F.translate(text, FROM, TO)
    group = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    question = group(plain, P.QUESTION_LEAD)
    letter = F.lit(None).cast("string") if prefixes is None else F.when(question.isNull() & F.array_contains(prefixes, F.regexp_extract(plain, SECTION_LETTER, 1)), F.regexp_extract(plain, SECTION_LETTER, 1))
    lead = F.coalesce(question, F.when(letter.isNotNull(), group(plain, SECTION_REST)))
    body = F.coalesce(lead, F.regexp_replace(plain, r"^\s+", ""))
    found = F.when(lead.isNotNull(), group(body, AFTER_LEAD)).otherwise(F.coalesce(group(body, WITH_ELEMENT), group(body, WITH_NUMBER), group(body, WITH_BRACKET)))
    stop = F.length(plain) - F.length(body) + F.length(found)
    after = F.substring(plain, stop + 1, F.lit(1))
    tokens = F.regexp_extract_all(found, F.lit(P.LABEL_TOKEN), F.lit(0))
    style = F.when(found.startswith("("), "parenthesised").when(lead.isNotNull() | F.element_at(tokens, 1).rlike("^[0-9]"), "numeric").otherwise("trailing_punct")
    raw = F.trim(F.regexp_replace(F.substring(text, F.lit(1), stop), r"\s+", " "))
    rest = F.regexp_replace(F.substring(text, stop + 1, F.length(text)), r"^\s+|\s+$", "")
    label = F.struct(raw.alias("raw"), tokens.alias("tokens"), style.alias("style"), letter.alias("section"), rest.alias("remainder"))
    return F.when(found.isNotNull() & ((after == "") | after.rlike(r"^\s")), label)


def section_prefixes(lines: DataFrame, paper: str, text: str) -> DataFrame:
    """paper, prefixes: the letters that at least MIN_PREFIX_USES different numbers follow at the start of its lines."""
    letter = F.regexp_extract(F.trim(F.col(text)), SECTION_LETTER, 1)
    number = F.regexp_extract(F.trim(F.col(text)), r"^[A-Z]\s?(\d{1,3})\b", 1).cast("int")
    seen = lines.select(paper, letter.alias("letter"), number.alias("number")).where("letter <> ''").distinct()
    often = seen.groupBy(paper, "letter").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PREFIX_USES)
    return often.groupBy(paper).agg(F.sort_array(F.collect_list("letter")).alias("prefixes"))


def canonical_qid(section: Column, tokens: Column) -> Column:
    """section/token/token..., without a section the tokens alone."""
    return F.concat_ws("/", section, tokens)
