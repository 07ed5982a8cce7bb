"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is a byte-fallback BPE vocabulary. A sequence of pieces is the model's encoding exactly
when every two neighbours encode to themselves, so encoding is a best path in a lattice whose arcs
are pieces and whose transitions weigh 0 (neighbours agree) or minus infinity. Giant documents are
split into chunks. The state at a cut is the piece that covers the character before it; each chunk
yields the transfer matrix between the states of its two cuts, the matrices are combined
associatively in the max-plus semiring, and the one state of finite weight at every cut lets each
chunk be backtraced on its own. A short document is a single chunk.

Between a character and a following word mark no piece can merge, so all paths meet there: inside a
chunk only the stretches before the first and after the last such place need a row for each state.

Defined results: null and empty texts have no pieces and decode to the empty text; as in the model, the
word mark U+2581 in a text reads as a space; repeated rows each give a row; a row without doc_id is a document; an
empty table gives no rows; of pieces of equal score the leftmost merges first; very long texts are encoded in chunks;
columns other than doc_id and text are ignored, whatever their names. In decoding, null ids are no pieces, control
ids and ids outside the vocabulary have no text, the unknown id reads as the model's sign for it, and bytes that are
no UTF-8 read as U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import cut, slices_of

CHUNK = 65_536  # characters of a chunk
SHORT = 32  # characters of a stretch that is merged instead of searched
MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_INSIDE = re.compile(f"(?<=[^{MARK}]){MARK}")
NO = -np.inf
UNKNOWN = " ⁇ ".encode()  # fixed value: how the model's library shows id 0


def load_vocabulary(model_file: str) -> tuple[dict[str, tuple[int, float]], dict[int, int]]:
    """(piece -> (id, score), byte -> id), read on the driver and sent to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids = {}, {}
    for i in range(len(sp)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[piece] = (i, sp.get_score(i))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a word mark after other characters; the scan needs marks only at the start")
    return pieces, byte_ids


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Words(dict):
    """word without spaces -> packed ids of the word behind a mark."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        e = self.encoder
        if "\n" in word and e.apart:
            first, *rest = word.split("\n")  # nothing merges with a line feed, so paths meet around it too
            return self[first] + b"".join([e.apart + (e.segment(part) if part else b"") for part in rest])
        if len(self) > 300_000:
            self.clear()
        got = self[word] = pack_ids(e.ids(e.path(MARK + word)))
        return got


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Lattice encoder of one vocabulary; remembers which neighbours agree and the encodings of words."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces))
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.byte_of = {i: b for b, i in byte_ids.items()}
        codecs.register_error("sign_for_each_byte", lambda e: ("\ufffd", e.start + 1))
        self.score_of = {p: score for p, (_, score) in pieces.items()}
        self.reach: dict[str, int] = {}  # length of the longest piece with the same first three characters
        for p in pieces:
            if len(p) > 2 and len(p) > self.reach.get(p[:3], 0):
                self.reach[p[:3]] = len(p)
        self.agreed: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.words = _Words(self)
        self.apart = b"" if any("\n" in p for p in pieces) else pack_ids(self.ids(["\n"]))  # a line feed that no piece holds
        shown = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.starts, self.shown = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(shown), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by merging: best score first, leftmost on ties."""
        parts, score_of = list(text), self.score_of
        scores = [score_of.get(a + b, NO) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NO:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score_of.get(parts[i - 1] + parts[i], NO)
            if i < len(scores):
                scores[i] = score_of.get(parts[i] + parts[i + 1], NO)
        return parts

    def agree(self, a: str, b: str) -> bool:
        """Whether b may follow a (a is empty at the start of a text)."""
        key = (a, b)
        got = self.agreed.get(key)
        if got is None:
            if len(self.agreed) > 400_000:
                self.agreed.clear()
            if a and a in self.pieces and b in self.pieces:
                got = self.merged(a + b) == [a, b]
            else:
                got = self.merged(b) == [b]
            self.agreed[key] = got
        return got

    def forward(self, text: str, start: int, last: str, end: int) -> dict[int, str]:
        """Last piece of the path to each place in (start, len(text)] that a piece starting before end reaches."""
        reached = {start: last}
        for at in range(start, end):
            a = reached.get(at)
            if a is None:
                continue
            for n in range(1, min(self.longest, len(text) - at) + 1):
                b = text[at : at + n]
                if (b in self.pieces or (n == 1)) and at + n not in reached and self.agree(a, b):
                    reached[at + n] = b
        return reached

    def back(self, reached: dict[int, str], end: int, start: int) -> list[str]:
        out = []
        while end > start:
            out.append(reached[end])
            end -= len(out[-1])
        return out[::-1]

    def walk(self, text: str) -> list[str]:
        """The path of finite weight through a whole stretch, depth first from the longest piece.

        The path to a place is unique, so a place from which the walk had to turn back is dead for good.
        """
        n, reach, pieces, agreed = len(text), self.reach, self.pieces, self.agreed
        path: list[str] = []
        dead: set[int] = set()
        at, last, size = 0, "", min(reach.get(text[:3], 2), n)
        while at < n:
            while size:
                b = text[at : at + size]
                if (b in pieces or size == 1) and at + size not in dead:
                    ok = agreed.get((last, b))
                    if ok or ok is None and self.agree(last, b):
                        break
                size -= 1
            if size:
                path.append(b)
                at, last = at + size, b
                size = min(reach.get(text[at : at + 3], 2), n - at)
            else:
                dead.add(at)
                b = path.pop()
                at, last, size = at - len(b), path[-1] if path else "", len(b) - 1
        return path

    def path(self, text: str) -> list[str]:
        """The path of finite weight through a whole stretch: a short one is merged, which ends in the same pieces."""
        return self.merged(text) if len(text) <= SHORT else self.walk(text)

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if got := self.pieces.get(p):
                out.append(got[0])
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def segment(self, text: str) -> bytes:
        """Packed ids of a stretch that starts and ends where all paths meet."""
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[text] = pack_ids(self.ids(self.path(text)))
        return got

    def meeting(self, text: str) -> bytes:
        """Packed ids of marked text between two places where all paths meet."""
        return b"".join([self.segment(m.group()) for m in _SEGMENT.finditer(text)])

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return self.meeting(MARK + text.replace(" ", MARK))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that encode made."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = self.shown[at].tobytes().decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text

    def read(self, ids: list[int | None]) -> str:
        """The text of any ids."""
        shown = [i for i in ids if i == 0 or i in self.bytes_of]
        raw = b"".join(UNKNOWN if i == 0 else self.bytes_of[i] for i in shown)
        if shown and shown[0] not in self.byte_of and raw[:1] == b" " and shown[0]:
            raw = raw[1:]
        return raw.decode("utf-8", "sign_for_each_byte")

    def states(self, behind: str, ahead: str) -> list[tuple[int, int]]:
        """Pieces that cover the character before a cut, as (characters before it, after it)."""
        return [
            (i, j)
            for i in range(1, min(len(behind), self.longest) + 1)
            for j in range(0, min(len(ahead), self.longest - i) + 1)
            if (i == 1 and j == 0) or behind[len(behind) - i :] + ahead[:j] in self.pieces
        ]

    def transfer(self, behind: str, body: str, ahead: str) -> np.ndarray:
        """Max-plus matrix from the states at the chunk's start to those at its end."""
        text = body + ahead
        into, out = self._into(behind, body), self.states(body[-self.longest :], ahead)
        whole = np.full((len(into), len(out)), NO)
        cut, shared = self._first_meeting(body), None
        for row, (last, skip) in enumerate(into):
            if skip > len(body):  # cannot happen for chunks longer than a piece
                continue
            if cut is None or skip > cut:
                reached = self.forward(text, skip, last, len(body))
            else:
                if cut not in self.forward(text[:cut], skip, last, cut):
                    continue
                if shared is None:
                    start = self._last_meeting(body)
                    shared = self.forward(text, start, "", len(body))
                reached = shared
            for col, (i, j) in enumerate(out):
                end = len(body) + j
                if reached.get(end) == text[end - i - j : end]:
                    whole[row, col] = 0.0
        return whole

    def backtrace(self, behind: str, body: str, ahead: str, entry: int, leave: int) -> bytes:
        """Packed ids of the pieces that start in the chunk, between a state at its start and one at its end."""
        text = body + ahead
        last, skip = self._into(behind, body)[entry]
        i, j = self.states(body[-self.longest :], ahead)[leave]
        end, cut = len(body) + j, self._first_meeting(body)
        if cut is None or skip > cut:
            return pack_ids(self.ids(self.back(self.forward(text, skip, last, len(body)), end, skip)))
        start = self._last_meeting(body)
        head = self.ids(self.back(self.forward(text[:cut], skip, last, cut), cut, skip))
        tail = self.ids(self.back(self.forward(text, start, "", len(body)), end, start))
        return pack_ids(head) + self.meeting(body[cut:start]) + pack_ids(tail)

    def _into(self, behind: str, body: str) -> list[tuple[str, int]]:
        if not behind:
            return [("", 0)]
        return [(behind[len(behind) - i :] + body[:j], j) for i, j in self.states(behind, body[: self.longest])]

    def _first_meeting(self, body: str) -> int | None:
        m = _INSIDE.search(body, 1)
        return m.start() if m else None

    def _last_meeting(self, body: str) -> int:
        at = len(body)
        while (at := body.rfind(MARK, 0, at)) > 0:
            if body[at - 1] != MARK:
                return at
        raise ValueError("no meeting place")


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a ⊗ b)[i, j] = max over k of a[i, k] + b[k, j]."""
    return (a[:, :, None] + b[None]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner cut that lies on the path of finite weight."""
    before = [matrices[0]]
    for m in matrices[1:-1]:
        before.append(max_plus(before[-1], m))
    after = [matrices[-1]]
    for m in matrices[-2:0:-1]:
        after.append(max_plus(m, after[-1]))
    return [int((f.max(0) + b.max(1)).argmax()) for f, b in zip(before, after[::-1])]


def _final(encoder: Encoder, matrix: np.ndarray, body: str) -> np.ndarray:
    """Of the last chunk, only states that end with the text."""
    ends = np.array([j == 0 for _, j in encoder.states(body[-encoder.longest :], "")])
    return np.where(ends[None], matrix, NO)


def encode_documents(docs: DataFrame, model_file: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_pieces, n_chunks, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text back)."""
    pieces, byte_ids = load_vocabulary(model_file or default_model())
    longest = max(map(len, pieces))
    if chunk <= longest:
        raise ValueError("a chunk must be longer than a piece")
    docs = docs.select("doc_id", "text")
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    result = "doc_id long, ids array<int>, n_pieces long, n_chunks int, ids_sha256 string, round_trip boolean"

    def row(doc_id: int | None, packed: bytes, n_chunks: int, text: str, encoder: Encoder) -> tuple:
        ids = np.frombuffer(packed, "<i4")
        return doc_id, ids, len(ids), n_chunks, hashlib.sha256(packed).hexdigest(), encoder.decode(ids) == text.replace(MARK, " ")

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[1]])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[1])))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), ids, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4]), pa.array(cols[5], pa.bool_())],
            names=["doc_id", "ids", "n_pieces", "n_chunks", "ids_sha256", "round_trip"],
        )

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, byte_ids)
        for batch in (part for whole in batches for part in slices_of(whole)):
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                rows.append(row(doc_id, encoder.encode(text), 1, text, encoder))
                held += len(rows[-1][1])
                if held > 1_000_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            for doc_id, text, h, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "h", "copies"))):
                marked = MARK + text.replace(" ", MARK)
                cuts = list(range(0, len(marked) - longest, chunk)) + [len(marked)]
                parts = [(marked[max(0, a - longest) : a], marked[a:b], marked[b : b + longest]) for a, b in zip(cuts, cuts[1:])]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32())] + [pa.array(x) for x in zip(*parts)],
                    names=["doc_id", "h", "copies", "i", "n", "behind", "body", "ahead"],
                )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, byte_ids)
        for batch in (part for whole in batches for part in slices_of(whole)):
            shapes, flat = [], []
            for behind, body, ahead in zip(*(batch.column(c).to_pylist() for c in ("behind", "body", "ahead"))):
                m = encoder.transfer(behind, body, ahead)
                m = m if ahead else _final(encoder, m, body)
                shapes.append(m.shape[1])
                flat.append(np.isfinite(m).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "h", "i")] + [pa.array(shapes, pa.int32()), pa.array([x.tolist() for x in flat], pa.list_(pa.bool_()))], names=["doc_id", "h", "i", "width", "paths"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for chunks in batch.column("chunks").to_pylist():
                ms = [np.where(np.array(c["paths"], bool).reshape(-1, c["width"]), 0.0, NO) for c in chunks]
                total = reduce(max_plus, ms)
                inner = boundary_states(ms) if len(ms) > 1 else []
                states.append([0, *inner, int(total.max(0).argmax())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(states, pa.list_(pa.int32()))], names=["s_doc", "s_h", "states"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, byte_ids)
        for batch in (part for whole in batches for part in slices_of(whole)):
            ids = [encoder.backtrace(b, t, a, s[i], s[i + 1]) for b, t, a, s, i in zip(*(batch.column(c).to_pylist() for c in ("behind", "body", "ahead", "states", "i")))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "h", "i")] + [pa.array(ids, pa.binary())], names=["doc_id", "h", "i", "ids"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, byte_ids)
        for batch in (part for whole in batches for part in slices_of(whole)):
            for doc_id, text, copies, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "chunks"))):
                yield pack([row(doc_id, b"".join([c["ids"] for c in chunks]), len(chunks), text, encoder)] * copies)

    small = docs.where(~giant).mapInArrow(short, result)
    long = docs.where(giant).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("text"))
    parts = cut(long.mapInArrow(split, "doc_id long, h long, copies long, i int, n int, behind string, body string, ahead string").repartition("doc_id", "h", "i"))
    met = parts.select("doc_id", "h", "i", "behind", "body", "ahead").mapInArrow(matrices, "doc_id long, h long, i int, width int, paths array<boolean>")
    solved = met.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("i", "width", "paths"))).alias("chunks")).mapInArrow(resolve, "s_doc long, s_h long, states array<int>")
    traced = parts.join(solved, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("h") == F.col("s_h"))).select("doc_id", "h", "i", "behind", "body", "ahead", "states").mapInArrow(trace, "doc_id long, h long, i int, ids binary")
    whole = traced.groupBy(F.col("doc_id").alias("t_doc"), F.col("h").alias("t_h")).agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("chunks"))
    big = long.join(whole, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("h") == F.col("t_h"))).select("doc_id", "text", "copies", "chunks").mapInArrow(join_up, result)
    return small.unionByName(big)


def decode_documents(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (array<int>)."""
    pieces, byte_ids = load_vocabulary(model_file or default_model())

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, byte_ids)
        for batch in (part for whole in batches for part in slices_of(whole)):
            texts = [encoder.read(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(per_batch, "doc_id long, text string")
