"""Assignment of blocks to questions, and the paper-line classifier: ordered folds by key.

An answer sheet is assigned in five passes: written labels, blocks that one question wins by the decisive margin,
continuations, joins, and the best monotone path for what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from docspan.functions import patterns as P
from docspan.operators.labels import parse_label
from docspan.operators.runs import fold_runs

SKIP_QUESTION, SKIP_BLOCK, CONTINUE, SHARE = -0.40, -0.80, -0.10, -0.45
GOES_ON, AGREES = 0.5, 1.0  # what a continuation marker and an answer so far add to going on
LONG_SHARE, SHORT_SHARE, SHARE_LENGTH = 0.55, -0.9, 1.4  # a shared block should be longer than its question's answer
ORDER_WEIGHT, LENGTH_WEIGHT, FLOOR, BEST_SHARE, FAR = 0.15, 0.2, 0.0, 0.70, -0.35
DECISIVE, TAIL, JOIN = 0.25, 2.0, 0.70
FRAGMENT = 12  # characters of a block that carries no opinion, at most
FREE, MATCHED, WENT_ON, SHARED = range(4)


@dataclass
class Sheet:
    """A sheet's blocks against a paper's questions; sim[i, j] is the similarity of question i and block j."""

    sim: np.ndarray
    paths: list[tuple[str, ...]] = field(default_factory=list)  # of the questions
    expected: list[float] = field(default_factory=list)  # words of a question's answer
    words: list[float] = field(default_factory=list)  # of the blocks
    chars: list[int] = field(default_factory=list)
    goes_on: list[bool] = field(default_factory=list)  # the block says that it continues elsewhere
    runs_on: list[bool] = field(default_factory=list)  # the block starts where the rest of the one above would
    labels: list[tuple[int, int]] = field(default_factory=list)  # confirmed (question, block), in order of the sheet

    def __post_init__(self):
        n, m = self.sim.shape
        self.paths = self.paths or [(str(i),) for i in range(n)]
        self.expected, self.words = self.expected or [0.0] * n, self.words or [0.0] * m
        self.chars, self.goes_on, self.runs_on = self.chars or [FRAGMENT + 1] * m, self.goes_on or [False] * m, self.runs_on or [False] * m

    def related(self, i: int, k: int) -> bool:
        """Siblings, or one path leads the other."""
        a, b = sorted((self.paths[i], self.paths[k]), key=len)
        return a[:-1] == b[:-1] or b[: len(a)] == a

    def parts(self, i: int, k: int) -> bool:
        """Parts of one numbered question."""
        a, b = sorted((self.paths[i], self.paths[k]), key=len)
        return len(b) > 1 and ((len(a) > 1 and a[:-1] == b[:-1]) or (len(a) < len(b) and b[: len(a)] == a))

    def support(self, i: int, j: int) -> float:
        """What the length of a block says about sharing it with one more question."""
        return 0.0 if not self.expected[i] else LONG_SHARE if self.words[j] >= SHARE_LENGTH * self.expected[i] else SHORT_SHARE


def pair_scores(sheet: Sheet, floor: float = FLOOR) -> np.ndarray:
    """Deviations from each block's mean with the priors of order and length; -inf where a pair is out of the question.

    Out are pairs below the floor, below 0.70 of the block's best or far below the mean, and the rivals of a question
    that leads a block by the decisive margin, unless they are parts of the same one.
    """
    sim = sheet.sim
    n, m = sim.shape
    if not n or not m:
        return np.full((n, m), -np.inf)
    deviation = sim - sim.mean(0)
    place = lambda k: np.arange(k) / (k - 1) if k > 1 else np.zeros(k)
    out = deviation + ORDER_WEIGHT * (1 - np.abs(place(n)[:, None] - place(m)))
    expected, words = np.maximum(sheet.expected, 6.0), np.maximum(sheet.words, 1.0)
    if any(sheet.expected):
        out = out + LENGTH_WEIGHT * np.minimum(words, expected[:, None]) / np.maximum(words, expected[:, None])
    out[(out <= FAR) | (sim <= floor) | (sim < BEST_SHARE * sim.max(0))] = -np.inf
    for j in range(m):
        live = np.flatnonzero(out[:, j] > -np.inf)
        if len(live) < 2:
            continue
        order = live[np.lexsort((-live, -deviation[live, j]))]
        if deviation[order[0], j] - deviation[order[1], j] >= DECISIVE:
            out[[i for i in order[1:] if not (deviation[order[0], j] > 0 and sheet.parts(order[0], i))], j] = -np.inf
    return out


def decided(scores: np.ndarray) -> list[int | None]:
    """The one question that each block is left with, if it is one."""
    live = scores > -np.inf
    return [int(live[:, j].argmax()) if live[:, j].sum() == 1 else None for j in range(scores.shape[1])]


def agreements(sheet: Sheet, scores: np.ndarray) -> list[int | None]:
    """The question of each decided block that the last block before it of more than a fragment was decided on too."""
    out, before = [], None
    for j, q in enumerate(decided(scores)):
        out.append(q if q is not None and q == before else None)
        if sheet.chars[j] > FRAGMENT:
            before = q
    return out


def align(scores: np.ndarray, goes_on: list[bool], agrees: list[int | None] | None = None, share: Callable[[int, int], float | None] | None = None) -> list[tuple[int, int]]:
    """(question, block) pairs of the best monotone path.

    A match may be followed by blocks that go on with the same question, or by further questions that share its
    block where share gives what that is worth. Ties go to the first offer: match, continue, share, skip question, skip block.
    """
    n, m = len(scores), len(scores[0]) if len(scores) else 0
    score = [list(map(float, row)) for row in scores]
    agrees = agrees or [None] * m
    low = float("-inf")
    table = [[[low] * (m + 1) for _ in range(n + 1)] for _ in range(4)]
    back: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    table[FREE][0][0] = 0.0

    def offer(state: int, i: int, j: int, value: float, source: tuple[int, int, int]) -> None:
        if value > table[state][i][j]:
            table[state][i][j] = value
            back[state, i, j] = source

    for i in range(n + 1):
        for j in range(m + 1):
            for state in (MATCHED, WENT_ON, SHARED, FREE):
                here = table[state][i][j]
                if here == low:
                    continue
                source = state, i, j
                if i < n and j < m and score[i][j] > low:
                    offer(MATCHED, i + 1, j + 1, here + score[i][j], source)
                if state in (MATCHED, WENT_ON) and j < m and score[i - 1][j] > low:
                    offer(WENT_ON, i, j + 1, here + CONTINUE + (GOES_ON if goes_on[j - 1] else 0) + (AGREES if agrees[j] == i - 1 else 0) + score[i - 1][j], source)
                if state in (MATCHED, SHARED) and share and i < n and score[i][j - 1] > low and (worth := share(i, j - 1)) is not None:
                    offer(SHARED, i + 1, j, here + SHARE + score[i][j - 1] + worth, source)
                if i < n:
                    offer(FREE, i + 1, j, here + SKIP_QUESTION, source)
                if j < m:
                    offer(FREE, i, j + 1, here + SKIP_BLOCK, source)
    at = (max((MATCHED, WENT_ON, SHARED, FREE), key=lambda state: table[state][n][m]), n, m)
    out = []
    while at in back:
        if at[0] != FREE:
            out.append((at[1] - 1, at[2] - 1))
        at = back[at]
    return out[::-1]


def align_sheet(sheet: Sheet) -> list[tuple[int, int]]:
    """The best monotone path of a sheet."""
    scores = pair_scores(sheet)

    def share(i: int, j: int) -> float | None:
        return sheet.support(i, j) if sheet.chars[j] and sheet.related(i - 1, i) else None

    return align(scores, sheet.goes_on, agreements(sheet, scores), share)


def assign(sheet: Sheet) -> list[tuple[int, int, str]]:
    """(question, block, pass) of the five passes, by block."""
    n, m = sheet.sim.shape
    owner: dict[int, tuple[int, str]] = {}  # block -> question and the pass that placed it
    taken: set[int] = set()

    def claim(i: int, j: int, how: str) -> None:
        owner[j] = i, how
        taken.add(i)

    for i, j in sheet.labels:  # the first confirmed label of a question claims its block
        if i not in taken and j not in owner:
            claim(i, j, "label")
    scores = pair_scores(sheet)
    alone = decided(scores)
    for _, j, i in sorted((-sheet.sim[i, j], j, i) for j, i in enumerate(alone) if i is not None and j not in owner):
        claim(i, j, "decided")  # strongest first; further blocks of a question are added to it
    best, top = (sheet.sim.max(0), sheet.sim.argmax(0)) if n else (np.zeros(m), np.zeros(m, int))
    second = np.sort(sheet.sim, axis=0)[-2] if n > 1 else np.zeros(m)
    for j in range(1, m):
        if j not in owner and j - 1 in owner and sheet.runs_on[j]:
            i = owner[j - 1][0]
            if top[j] == i or sheet.parts(i, int(top[j])) or (best[j] <= FLOOR or best[j] < TAIL * second[j]) and sheet.chars[j] <= FRAGMENT:
                owner[j] = i, "continuation"
    for j in range(m):
        placed = [sheet.sim[top[j], k] for k, (i, _) in owner.items() if i == top[j]]
        if j not in owner and placed and best[j] > FLOOR and best[j] >= JOIN * max(placed):
            owner[j] = int(top[j]), "join"
    qs, bs = [i for i in range(n) if i not in taken], [j for j in range(m) if j not in owner]
    out = [(i, j, how) for j, (i, how) in owner.items()]
    if qs and bs:
        pick = lambda values, at: [values[k] for k in at]
        rest = Sheet(sheet.sim[np.ix_(qs, bs)], pick(sheet.paths, qs), pick(sheet.expected, qs), pick(sheet.words, bs), pick(sheet.chars, bs), pick(sheet.goes_on, bs), pick(sheet.runs_on, bs))
        out += [(qs[i], bs[j], "path") for i, j in align_sheet(rest)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def by_sheet(blocks: DataFrame, items: list[tuple[int, tuple[str, ...], float]], solve: Callable[[Sheet], list[tuple]], key: str) -> DataFrame:
    """key, block, question and how of every sheet; a block without a question is a row too.

    blocks: key, ordinal, block, pairs (item and score), words, chars, goes_on, runs_on, label (item or null). items:
    the questions in order, with path and expected words; they are the small side and travel with the task.
    """
    names = [i for i, _, _ in items]
    place = {name: k for k, name in enumerate(names)}

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = [r for part in parts for r in part.to_pylist()]
        sim = np.zeros((len(names), len(rows)))
        for j, r in enumerate(rows):
            for p in r["pairs"]:
                sim[place[p["item"]], j] = p["score"]
        used = np.flatnonzero(sim.any(1))  # questions that no block resembles cannot be placed
        row = {int(k): i for i, k in enumerate(used)}
        labels = [(row[place[r["label"]]], j) for j, r in enumerate(rows) if r["label"] in place and place[r["label"]] in row]
        column = lambda c: [r[c] for r in rows]
        sheet = Sheet(sim[used], [items[k][1] for k in used], [items[k][2] for k in used], column("words"), column("chars"), column("goes_on"), column("runs_on"), labels)
        found: dict[int, list[tuple[int, str]]] = {}
        for i, j, *how in solve(sheet):
            found.setdefault(j, []).append((names[used[i]], how[0] if how else "path"))
        told = [(r[key], r["block"], q, how) for j, r in enumerate(rows) for q, how in found.get(j, [(None, None)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[key, "block", "question", "how"])

    return fold_runs(blocks, key, ["ordinal"], fold, f"{key} string, block long, question long, how string")


_PATTERN = {name: re.compile(getattr(P, name)) for name in ("SECTION_HEADER", "ONLY_MARKS", "PAGE_NUMBER", "PER_QUESTION_MARKS", "MARKS_EACH", "BRACKETED_ASIDE", "PAGE_MARKER", "POINTS_AT_MATERIAL", "POINTS_AT_ITS_PARTS", "INVITES_ANSWERS")}
_NUMBER = re.compile(r"\d{1,3}")


def classify_lines(texts: list[str], repeated: set[str] = frozenset(), edges: set[int] = frozenset()) -> list[str]:
    """Roles of a paper's lines, in order; the first rule that holds decides."""
    roles: list[str] = []
    started = open_ = False
    previous = ""
    for at, text in enumerate(texts):
        role = _role(text, texts[at + 1 : at + 13], at in edges, text in repeated, started, open_, previous)
        if _PATTERN["POINTS_AT_MATERIAL"].search(text.strip()) and role in ("instruction", "furniture", "question_continuation"):
            open_ = True
            role = "instruction"
        if role in ("question_start", "section_header"):
            open_ = False
            started = started or role == "question_start"
        previous = "" if role in ("section_header", "instruction", "furniture", "material") else role
        roles.append(role)
    return roles


def _role(text: str, following: list[str], at_edge: bool, repeated: bool, started: bool, open_: bool, previous: str) -> str:
    plain = text.strip()
    if not plain or repeated:
        return "furniture"
    lowered = plain.lower()
    header = _PATTERN["SECTION_HEADER"].search(plain) is not None
    rubric = any(p in lowered for p in P.INSTRUCTION_PHRASES)
    label = parse_label(text)
    if open_ and not header and not rubric and not label:
        return "material"
    if plain[0] in "\"“‘'":
        return "material"
    if header:
        return "section_header"
    if _PATTERN["ONLY_MARKS"].search(plain):
        return "marks"
    if _PATTERN["PAGE_NUMBER"].search(plain):
        return "furniture"
    if rubric or _PATTERN["PER_QUESTION_MARKS"].search(plain) or _PATTERN["MARKS_EACH"].search(plain):
        return "instruction"
    if _PATTERN["BRACKETED_ASIDE"].search(plain):
        return "furniture"
    if label:
        body = label.remainder
        if len(body) < 3:
            body = next((f.strip() for f in following if len(f.strip()) >= 12 or parse_label(f)), "")
            body = "" if parse_label(body) else body
        if len(body) < 3:
            return "furniture"
        return "question_start" if started or _NUMBER.fullmatch(label.tokens[0]) else "instruction"
    if at_edge and _PATTERN["PAGE_MARKER"].search(plain):
        return "furniture"
    if _PATTERN["POINTS_AT_ITS_PARTS"].search(plain) and (plain.endswith(":") or _PATTERN["INVITES_ANSWERS"].search(plain)):
        return "instruction"
    return "question_continuation" if previous in ("question_start", "question_continuation", "stem") else "furniture"


def classify_papers(lines: DataFrame) -> DataFrame:
    """paper_id, ord, role, text: one paper is one small group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        return pdf.assign(role=classify_lines(pdf["text"].tolist()))[["paper_id", "ord", "role", "text"]]

    return lines.groupBy("paper_id").applyInPandas(fold, "paper_id long, ord long, role string, text string")
