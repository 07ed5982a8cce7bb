"""Small scalar rules of marking and review, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions import patterns as P
from docspan.functions.text import extracted, normalise_spaces

MAX_WAIT = 90.0
_SMALL = ("one", "two", "three", "four", "five", "six")
_ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")
#: Fixed value: a request for a number of things, the number and the noun after it.
COUNTED = r"\b(?:any\s+)?(one|two|three|four|five|six|[1-6])\s+(?!marks?\b)([a-z][a-z-]{2,})"


def requested_count(text: Column) -> Column:
    """How many things a question asks for: not units, not marks, and only after a command word."""
    opening, number, noun = (F.lower(F.regexp_extract(text, "(?is)^(.*?)" + COUNTED, g)) for g in (1, 2, 3))
    number = F.nullif(number, F.lit(""))
    commanded = F.lit(False)
    for word in P.COMMANDS:
        commanded = commanded | opening.contains(word)
    word_value = F.nullif(F.array_position(F.array(*map(F.lit, _SMALL)), number).cast("int"), F.lit(0))
    value = F.when(number.rlike("^[0-9]$"), F.ascii(number) - 48).otherwise(word_value)
    return F.when(commanded & ~noun.isin(*P.UNITS), value)


def ordinal(n: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, _ORDINALS)), F.nullif(n, F.lit(0)).cast("int")), F.concat(n.cast("string"), F.lit("th")))


def third_person(verb: Column) -> Column:
    v = F.lower(verb)
    ending = F.when(v.rlike("(s|x|z|ch|sh)$"), F.concat(v, F.lit("es"))).when(v.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(v, "y$", ""), F.lit("ies"))).otherwise(F.concat(v, F.lit("s")))
    return F.when(v.rlike("^[a-z]+$"), ending).otherwise(verb)


def as_statement(ask: Column) -> Column:
    """"Does the answer give x?" as "The answer gives x"; anything else without its question mark."""
    text = F.trim(F.regexp_replace(F.trim(ask), r"\?+$", ""))
    rest = extracted(text, r"(?i)^(?:does|do|did|has|have)\s+(?:the\s+)?(?:answer|student|response)\s+(.+)$", 1)
    verb, tail = F.substring_index(rest, " ", 1), F.regexp_replace(rest, r"^\S+\s*", "")
    return F.when(rest.isNotNull(), F.trim(F.concat_ws(" ", F.lit("The answer"), third_person(verb), tail))).otherwise(text)


def wait_seconds(message: Column, attempt: Column) -> Column:
    """Seconds that a rate-limit message asks for, null above the limit; without a number 2 ** attempt."""
    pattern = r"(?i)try again in\s+(?:(\d+)m)?([\d.]+)s"
    asked = F.coalesce(extracted(message, pattern, 1).cast("double"), F.lit(0.0)) * 60 + extracted(message, pattern, 2).cast("double")
    return F.when(asked.isNotNull(), F.when(asked <= MAX_WAIT, asked)).when(message.contains("429"), F.least(F.lit(MAX_WAIT), F.pow(F.lit(2.0), attempt)))


def parse_mark(raw: Column, available: Column) -> Column:
    """struct<given, valid>: an empty entry clears the mark; otherwise a number from 0 to available."""
    text = F.trim(raw)
    value = text.try_cast("double")
    ok = value.isNotNull() & value.between(F.lit(0.0), available)
    return F.struct(F.when(ok, value).alias("value"), ((F.length(text) == 0) | F.coalesce(ok, F.lit(False))).alias("valid"))


def trim_mark(mark: Column) -> Column:
    return F.when(mark == F.floor(mark), F.floor(mark).cast("string")).otherwise(F.format_string("%.1f", mark))


def score_label(final: Column, available: Column) -> Column:
    return F.when(available > 0, F.concat(trim_mark(final), F.lit(" / "), trim_mark(available)))


def score_tone(final: Column, available: Column, judged: Column) -> Column:
    return F.when((available <= 0) | ~judged, "none").when(final <= 0, "zero").when(final >= available, "pass").otherwise("partial")


def preview(text: Column) -> Column:
    flat = normalise_spaces(text)
    return F.when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 60), F.lit("…"))).otherwise(flat)


def caption(message: Column, done: Column, total: Column) -> Column:
    counted = done.isNotNull() & (total > 0) & ~F.lower(message).contains("page")
    return F.when(F.length(message) > 0, F.when(counted, F.concat(message, F.lit(" · page "), done.cast("string"), F.lit(" of "), total.cast("string"))).otherwise(message))


def expected_label(neighbour: Column, present: Column, missing: Column) -> Column:
    """A neighbour's label with the missing number in place of its own."""
    return F.regexp_replace(neighbour, F.concat(F.lit(r"\b"), present.cast("string"), F.lit(r"\b")), missing.cast("string"))


def multiset_recall(truth: Column, predicted: Column) -> Column:
    """Share of the truth's words (lower case, letters and digits) that the prediction has, counted with repetition."""
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    a, b = words(truth), words(predicted)
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return F.try_divide(shared.cast("double"), F.size(a).cast("double"))


def linear_light(share: Column) -> Column:
    return F.when(share <= 0.04045, share / 12.92).otherwise(F.pow((share + 0.055) / 1.055, F.lit(2.4)))


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast of two #rrggbb colours."""

    def luminance(c: Column) -> Column:
        part = lambda at: linear_light(F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255)
        return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)

    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)

