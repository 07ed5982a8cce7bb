"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. The ledger stores the measurements and one bit for each rule that
the text fails; a policy is a versioned mask of the rules that count, so keeping or dropping a document
and the ablation of a policy (what each rule drops, alone and given the others) are bitwise operations on
the ledger, without reading the texts again.

Defined results: a null or empty text has no words, no symbols and no lines and fails the base rule for
few words; measurements that divide by the words are 0 there; repeated rows each give a row; a measurement exactly
at a limit passes; an empty table gives an empty ledger and an ablation without rules; very long texts are measured
whole; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import MIX, WordHashes, mix64, slices_of, word_hashes

#: The symbols that are counted.
_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_BLANK = re.compile(r"[ \t-\r]*")
REPEAT_WINDOW = 5

#: Rules by bit: few words and repeated words are the base rules.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "few_letters", "pipes")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return BASE_MASK | sum(BIT[r] for r in self.rules if not BIT[r] & BASE_MASK)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols")),
    "v2": Policy("v2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "few_letters", "pipes")),
}
CURRENT = "v2"


_letters: list[np.ndarray] = []


def letters_of(text: str, raw: np.ndarray) -> int:
    """Number of letters of a text. raw: its UTF-8 bytes."""
    ascii_letters = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122))
    if text.isascii():
        return int(ascii_letters)
    if not _letters:  # by code point, made where first needed
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return int(np.count_nonzero(_letters[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))


def measure(text: str | None, memo: WordHashes) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words, n_letters."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    bytes_ = np.frombuffer(raw, np.uint8)
    blank = np.count_nonzero((bytes_ == 32) | ((bytes_ >= 9) & (bytes_ <= 13)))
    symbols = int(np.count_nonzero(_IS_SYMBOL[bytes_]))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if not line or _BLANK.fullmatch(line):
            continue
        lines += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    repeat = 0
    if n > REPEAT_WINDOW:
        h = word_hashes(words, memo)
        windows = np.zeros(n - REPEAT_WINDOW + 1, np.uint64)
        for i in range(REPEAT_WINDOW):
            windows = (windows ^ h[i : n - REPEAT_WINDOW + 1 + i]) * MIX
            windows ^= windows >> np.uint64(29)
        windows = mix64(windows)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            covered[at] += 1
            covered[at + REPEAT_WINDOW] -= 1
            repeat = int(np.count_nonzero(np.cumsum(covered)[:n] > 0))
    return n, len(text) - int(blank), symbols, dup, lines, repeat, letters_of(text, bytes_)


def failures(n: int, chars: int, symbols: int, dup: int, lines: int, repeat: int, letters: int, pipes: int) -> int:
    """The failure bits of a text."""
    bits = 0
    if n < 10:
        bits |= BIT["few_words"]
    if 100 * repeat > 20 * n:
        bits |= BIT["repeated_words"]
    if 100 * symbols > 30 * n:
        bits |= BIT["symbols"]
    if 100 * dup > 50 * lines:
        bits |= BIT["duplicate_lines"]
    if n and not 2 <= chars / n <= 20:
        bits |= BIT["word_length"]
    if 100 * letters < 50 * chars:
        bits |= BIT["few_letters"]
    if 100 * pipes > 30 * n:
        bits |= BIT["pipes"]
    return bits


def quality_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_letters, failed (bitmask)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "failed"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in (part for whole in batches for part in slices_of(whole)):
            rows = []
            for t in batch.column("text").to_pylist():
                m = measure(t, memo)
                rows.append((*m, failures(*m, t.count("|") if t else 0)))
            table = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(per_batch, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def verdict(failed: Column, policy: Policy) -> Column:
    """Whether a policy keeps a document."""
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    base = F.col("failed").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0
    return ledger.select("*", base.alias("base_failed"), verdict(F.col("failed"), POLICIES[version]).alias("kept"), F.lit(version).alias("policy"))


def ablation(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only (dropped by this rule alone), n_kept_without (kept if the rule is left out).

    The documents are first counted by failure mask, of which there are at most 2 ** rules.
    """
    policy = POLICIES[version]
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in RULES if BIT[r] & policy.mask]
    each = masks.select("n", F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("failed"), F.explode(F.array(*rules)).alias("r"))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == bit, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


_LEDGER = r"""
t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
g as (select r, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) as win from w where len(ws) >= 5),
b as (select r, i from (select r, i, count(*) over (partition by r, win) as n from g) where n > 1),
c as (select r, count(distinct i + o) as n_repeat_words from b, range(5) x(o) group by 1),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n_letters, length(regexp_replace(text, '[^|]', '', 'g')) as pipes from w left join c using (r) left join l using (r)),
f as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when 100 * n_symbols > 30 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end
  + case when n_words > 0 and not word_chars / n_words::double between 2 and 20 then 16 else 0 end + case when 100 * n_letters < 50 * word_chars then 32 else 0 end + case when 100 * pipes > 30 * n_words then 64 else 0 end)::bigint as failed from m)"""
ORACLE = f"with {_LEDGER} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, n_lines, n_letters, failed, 'v2' as policy from f"
ABLATION_ORACLE = f"with {_LEDGER}, rules as (select * from (values {', '.join(f"('{name}', {bit})" for name, bit in BIT.items())}) x(rule, bit)) select rule, count(*) filter (where failed & bit <> 0) as n_failed, count(*) filter (where failed = bit) as n_only, count(*) filter (where failed & ~bit = 0) as n_kept_without from f, rules group by 1"
