"""Toxicity scores behind a noisy-channel deobfuscation.

A token that may be disguised (leetspeak, stretched letters, letters set apart by spaces or marks)
becomes a character lattice: each observed character offers its literal reading and the letters it
may stand for. Viterbi decoding under a character trigram model counted over the whole corpus
picks the reading; the restored words are then scored by a logistic model over a lexicon of words
learnt from the labelled rows.

Defined results: a null or empty text has no words and gets the model's intercept score; repeated
rows are scored alike; unlabelled, null-labelled and conflicting rows are never trained on (a
document with both labels is left out); a row without doc_id is scored and not held out; with no usable
labels every score is 0; an empty table gives no rows; readings of equal cost go to the one found first, in
order of the characters. Very long texts are read whole, and a very long token is decoded in time and memory
that grow in proportion. Columns other than doc_id and text are ignored, whatever their names (keep_clean passes
them on).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import cut, slices_of

ALPHABET = 28  # 0 is a word boundary, 1-26 letters, 27 any other letter
#: Letters that a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_=+~/\\"
_APART = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\S)")
_APART_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_STRETCH = re.compile(r"(.)\1\1")
_LEETY = re.compile("[" + re.escape("".join(LEET)) + "]")
_HAS_LETTER = re.compile(r"[^\W\d_]")

SUBSTITUTION_COST = math.log10(0.05)  # channel: a letter is disguised
DROP_COST = math.log10(0.05)  # channel: a mark or a repeated letter carries nothing
SAMPLE_LIMIT = 20_000  # labelled rows that the logistic model is fitted on, at most
BROADCAST_LABELS = 500_000  # labels that may be broadcast; beyond it the join shuffles
MIN_SUPPORT = 8  # distinct texts of label 1 that hold a word of the lexicon, at least (a quarter of them, if they are few)
MIN_SHARE = 0.002  # of the texts of label 1 that hold it, at least; so the lexicon does not grow with the number of texts
MIN_RATIO = 3.0  # rate in texts of label 1 over the rate in others, at least
MIN_G2 = 15.0  # likelihood ratio statistic of a word against chance, at least


class CharModel:
    """Character trigram model with add-one smoothing; log10 probabilities."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        uni = c.sum((0, 1)) + 1
        bi = c.sum(0) + uni / uni.sum()
        bi /= bi.sum(1, keepdims=True)
        tri = (c + 4 * bi[None]) / (c.sum(2, keepdims=True) + 4)
        self.log = np.log10(tri).tolist()


def _code(ch: str) -> int:
    o = ord(ch) - 96
    return o if 0 < o < 27 else 27


_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = range(1, 27)
_CLASS[128:] = 27


def _trigram_codes(raw: np.ndarray) -> np.ndarray:
    c = np.zeros(len(raw) + 3, np.int64)
    c[2:-1] = _CLASS[raw]
    tri = (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]
    return tri[(c[1:-1] > 0) | (c[2:] > 0)]


def _count(texts: list[bytes]) -> np.ndarray:
    return np.bincount(_trigram_codes(np.frombuffer(b" ".join(texts), np.uint8)), minlength=ALPHABET**3)


def _options(token: str) -> Iterator[list[tuple[str, float]]]:
    """The lattice: for each character its readings with channel costs; '' drops it."""
    for i, ch in enumerate(token):
        here: list[tuple[str, float]] = []
        repeated = i > 0 and token[i - 1] == ch
        if _HAS_LETTER.match(ch):
            here.append((ch, 0.0))
            if repeated:
                here.append(("", DROP_COST if not (i > 1 and token[i - 2] == ch) else 0.0))
        else:
            here += [(x, SUBSTITUTION_COST) for x in LEET.get(ch, "")]
            here.append(("", 3 * DROP_COST if ch.isalnum() else DROP_COST if ch in LEET else 0.0))
        yield here


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a token: Viterbi over its lattice with back pointers."""
    log = model.log
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in _options(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for ch, cost in options:
                if ch:
                    c = _code(ch)
                    key, total = (b, c), score + cost + log[a][b][c]
                else:
                    key, total = (a, b), score + cost
                held = after.get(key)
                if held is None or total > held[0]:
                    after[key] = (total, (path, ch) if ch else path)
        best = after
    _, path = max(((score + log[a][b][0], path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out))


def suspicious(core: str) -> bool:
    return bool(_HAS_LETTER.search(core)) and bool(_LEETY.search(core) or _STRETCH.search(core) or _APART.fullmatch(core))


@dataclass
class Restorer:
    """Restored words of whole texts; readings are memoised by token."""

    model: CharModel
    memo: dict[str, str] = field(default_factory=dict)

    def token(self, token: str) -> str:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            core = token.strip(EDGE)
            lead = token[: len(token) - len(token.lstrip(EDGE))]
            if lead and lead[-1] in LEET and core and _HAS_LETTER.match(core) and lead[-1] not in "(*|+":
                core = lead[-1] + core
            got = self.memo[token] = restore(core, self.model) if suspicious(core) else core
        return got

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        text = text.lower()
        found = set(map(self.token, set(text.split())))
        for run in _APART_SPACED.finditer(text):
            letters = run.group().replace(" ", "")
            found.add(restore(letters, self.model) if suspicious(letters) else letters.strip(EDGE))
        found.discard("")
        return found


def char_model(docs: DataFrame) -> CharModel:
    """Counts over every text, summed by class trigram (a table of fixed size) across tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in (part for whole in batches for part in slices_of(whole)):
            joined: list[bytes] = []
            held = 0
            for text in batch.column(0).to_pylist():
                if text:
                    joined.append(text.lower().encode("utf-8", "surrogatepass"))
                    held += len(joined[-1])
                if held > 1 << 20:
                    total += _count(joined)
                    joined, held = [], 0
            total += _count(joined)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["tri", "n"])

    counts = np.zeros(ALPHABET**3, np.int64)
    for row in docs.select("text").mapInArrow(count, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect():
        counts[row.tri] = row.n
    return CharModel(counts)


@dataclass
class ToxicityModel:
    char: CharModel
    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[self.lexicon[w]] for w in words & self.lexicon.keys())
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))


def _fold(column: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> ToxicityModel:
    """Learn from labelled rows outside fold 0.

    The lexicon is every word of their distinct texts that passes MIN_SUPPORT, MIN_SHARE, MIN_RATIO and MIN_G2;
    word counts cover all of them. Only the weights are fitted on a bounded sample, the SAMPLE_LIMIT rows with the
    smallest hash of doc_id.
    """
    char = char_model(docs)
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select(F.col("doc_id").alias("label_id"), F.col("y").cast("int").alias("y"))
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        clean = F.broadcast(clean)
    train = docs.select("doc_id", "text").where(_fold("doc_id", folds) != 0).join(clean, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y", F.xxhash64("text").alias("h"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(char)
        for batch in (part for whole in batches for part in slices_of(whole)):
            rows = [sorted(restorer.words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("h"), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "y", "h", "words"])

    by_row = cut(train.mapInArrow(words, "doc_id long, y int, h long, words array<string>"))
    unique = by_row.dropDuplicates(["h", "y"])
    totals = {r.y: r.n for r in unique.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return ToxicityModel(char, {}, np.zeros(0), -60.0)
    counts = unique.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    counts = counts.where(F.col("p") >= max(min(MIN_SUPPORT, max(2, pos // 4)), MIN_SHARE * pos))
    rate, base = (F.col("p") + 0.5) / (pos + 1.0), (F.col("q") + 0.5) / (neg + 1.0)
    lexicon = {r.w: i for i, r in enumerate(counts.where((rate > MIN_RATIO * base) & (_g2(F.col("p"), F.col("q"), pos, neg) >= MIN_G2)).select("w").orderBy("w").collect())}
    known = F.split(F.lit(" ".join(lexicon)), " ")  # words hold no spaces
    narrow = by_row.select("doc_id", "y", F.array_intersect("words", known).alias("hits"))
    sample = narrow.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_LIMIT).select("y", "hits").collect()
    x = np.zeros((len(sample), len(lexicon)), bool)
    for i, row in enumerate(sample):
        x[i, [lexicon[w] for w in row.hits]] = True
    weights, bias = _logistic(x, np.array([r.y for r in sample], float))
    return ToxicityModel(char, lexicon, weights, bias)


def _g2(p: Column, q: Column, pos: int, neg: int) -> Column:
    """Likelihood ratio statistic of a word that p of pos and q of neg texts hold."""
    held = p + q
    cells = ((p, held * pos), (q, held * neg), (pos - p, (pos + neg - held) * pos), (neg - q, (pos + neg - held) * neg))
    return 2 * sum((F.when(n > 0, n * F.log(n * float(pos + neg) / expected)).otherwise(0.0) for n, expected in cells), F.lit(0.0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30, block: int = 2_000) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps over blocks of rows; the intercept is not penalised."""
    n = x.shape[1] + 1
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-3
    w = np.zeros(n)
    for _ in range(steps):
        hessian, slope = np.diag(penalty), -penalty * w
        for lo in range(0, len(x), block):
            a = np.hstack([x[lo : lo + block], np.ones((len(x[lo : lo + block]), 1))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian += (a * (p * (1 - p))[:, None]).T @ a
            slope += a.T @ (y[lo : lo + block] - p)
        step = np.linalg.solve(hessian, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_hits, restored: the lexicon words found in the restored text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.char)
        for batch in (part for whole in batches for part in slices_of(whole)):
            found = [restorer.words(t) & model.lexicon.keys() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.score(w) for w in found], pa.float64()), pa.array([len(w) for w in found], pa.int32()), pa.array([sorted(w) for w in found], pa.list_(pa.string()))],
                names=["doc_id", "score", "n_hits", "restored"],
            )

    return docs.select("doc_id", "text").mapInArrow(per_batch, "doc_id long, score double, n_hits int, restored array<string>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.char)
        for batch in (part for whole in batches for part in slices_of(whole)):
            keep = [model.score(restorer.words(t)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_batch, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """Score every text: doc_id, held_out, score, predicted, n_hits, restored."""
    return score(docs, fit(docs, labels, folds)).select(
        "doc_id", (_fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "restored"
    )
