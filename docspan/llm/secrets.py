"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings.

Base spans (code points, end exclusive, the whole match; leftmost and non-overlapping for each kind):
assign is a credential word with a value of 6 or more characters, access is ``AKIA`` and capitals or
digits, 20 or more, hex is a run of 24 or more lower-case hex digits. The entropy method adds spans of
kind ``entropy``: a candidate is a run of 20 or more token characters; the narrowest character class that
covers it sets the threshold. The entropy and the number of different characters of every 20-character window are
kept up by incremental counts, and the windows that exceed the threshold with more than five different characters
are merged. Candidates that an allow-list rule knows (words, numbers, paths and addresses, UUIDs, repeated
patterns) are suppressed, as are spans inside a base span.

Defined results: a null or empty text has no spans and the hash of the empty string; repeated rows each
give a row; spans that start together come in the order of the kinds; an empty table gives no rows; a very long text
or candidate takes time in proportion and memory for its own spans only; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspan.llm.text import slices_of

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")

WINDOW = 20
#: Character classes from narrow to wide, with the entropy in bits a character that a window must exceed.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), math.inf),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 2.9),
    ("base32", re.compile(r"[A-Z2-7]+=*"), 3.4),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8),
)
ALLOWED = (
    re.compile(r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*[-_/]?"),  # words and paths of words
    re.compile(r"[A-Z]+(?:[-_/][A-Z]+)*"),
    re.compile(r"[0-9]+(?:[-_/.][0-9]+)*"),  # numbers and dates
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[=_+/-]+"),  # rules
    re.compile(r"(?:[A-Z]?[a-z]{2,}[0-9]{0,4}[-_/])+[A-Za-z]*[0-9]{0,4}"),  # names with short numbers
)
_PLOGP = [0.0] + [n / WINDOW * math.log2(n / WINDOW) for n in range(1, WINDOW + 1)]


def window_entropies(text: str, width: int = WINDOW) -> Iterator[tuple[float, int]]:
    """Shannon entropy and number of different characters of each window, from counts that change by one character in
    and one out."""
    plogp = _PLOGP if width == WINDOW else [0.0] + [n / width * math.log2(n / width) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, kinds = 0.0, 0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        kinds += n == 0
        if i >= width:
            total += plogp[n + 1] - plogp[n] if n < width else 0.0
            c = text[i - width]
            n = counts[c]
            counts[c] = n - 1
            kinds -= n == 1
            total += plogp[n - 1] - (plogp[n] if n <= width else 0.0)
        else:
            total += plogp[n + 1] - plogp[n]
        if i >= width - 1:
            yield -total, kinds


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Merged windows of high entropy over the candidates of a text."""
    spans: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        found = m.group()
        if any(rule.fullmatch(found) for rule in ALLOWED):
            continue
        threshold = next(limit for _, pattern, limit in CLASSES if pattern.fullmatch(found))
        for i, (h, kinds) in enumerate(window_entropies(found)):
            if h > threshold and kinds > 5:
                a, b = m.start() + i, m.start() + i + WINDOW
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
    return spans


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    if not _may_hold(text):
        return [], []
    base = base_spans(text)
    added = [(a, "entropy", b) for a, b in entropy_spans(text) if not any(s <= a and b <= e for s, _, e in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1])))


def _may_hold(text: str) -> bool:
    """Whether a text can hold any span: a long run, or a sign that assigns."""
    return ":" in text or "=" in text or _CANDIDATE.search(text) is not None


def _told(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array(np.array([sum(k == kind for _, k, _ in every) for _, every in found], np.int64)) for kind in KINDS]
            told = [pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([_told(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *told], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(per_batch, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
