"""Language-model scores: a causal self-attention model over subword ids, and a word unigram base.

A text is its subword ids (a public byte-level BPE) and an end id; its score is the sum of their log10
probabilities under the model of attention.py, in which attention and its output projection give the class of each
id and exact counts of pairs of ids give the id inside the class. Windows overlap and each id is scored once.

Learning uses only rows whose crc32(doc_id as text) mod folds is not 0, and all of their text. Counts of ids and of
pairs are exact and complete: nothing is cut off, and the table of pairs stays distributed and grows with the input.
The attention weights are trained on every id of every training document once: documents are dealt by hash to
ROUNDS rounds of shards, in each round every shard trains on its documents, in order of their hash, from the weights
of the round before, and the shards' weights are averaged in fixed point. So the weights, and with them all
scores, depend on the documents alone and not on partitions or tasks.

Exchange of counts. Each batch of texts asks for the counts of its distinct words and pairs, in buckets by hash;
equal ones of all batches meet, and the sums come back to the batch. Nothing that grows with the vocabulary or
the corpus reaches the driver; it holds the counts of the ids of the fixed subword vocabulary.

Defined results: a null or empty text is the end token alone; repeated rows each give a row (and count in
training as often); an empty table gives no rows; a row without doc_id is training text; with no training rows all
counts are 0 and score falls back on uniform ids; equal texts have equal scores; very long texts are scored whole, a
chunk of positions at a time; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.attention import Attention, Vocabulary, lay
from docspan.llm.text import MIX, cut, delete, mix64, runs_in_partition, shuffle_width, slices_of, words_of

ROUNDS = 3  # of training; the weights are averaged after each
SHARD_ROWS = 4096  # documents that a shard trains on, about, ...
SHARDS = 4096  # ... in a round of so many shards at most
FIXED = 1 << 32  # weights are averaged and scores summed in units of 1 / FIXED
BATCH_BYTES = 4 << 20
PARTS = 64  # counts and weights are summed in so many parts
DENSE = 1 << 24  # pairs of a batch are counted in a table up to this size
WORDS, PAIRS, TOKENS, HEADS, IDS = range(5)  # kinds of rows


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


class Tokens:
    """Subword ids of texts; end is the id after the last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.last = np.array([self.end], np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return self.last
        return np.array([*self.encoding.encode_ordinary(text), self.end], np.int32)  # faster than encode_to_numpy


class _Index(dict):
    """word -> place in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Integers, in 16 or 32 bits where they fit, with their count and packed size in front."""
    values = np.asarray(values)
    kind = np.uint16 if not len(values) or values.min() >= 0 and values.max() < 1 << 16 else np.int32 if values.min() >= -(1 << 31) and values.max() < 1 << 31 else np.int64
    data = pa.compress(np.ascontiguousarray(values, kind).tobytes(), codec="zstd", asbytes=True)
    return (len(values) << 4 | np.dtype(kind).itemsize).to_bytes(8, "little") + len(data).to_bytes(8, "little") + data


def _arrays(data: bytes) -> list[np.ndarray]:
    """int64 values of each of the packed arrays in a row."""
    out, at = [], 0
    while at < len(data):
        n, size = (int.from_bytes(data[at + i : at + i + 8], "little") for i in (0, 8))
        kind = np.dtype({2: np.uint16, 4: np.int32, 8: np.int64}[n & 15])
        raw = pa.decompress(memoryview(data)[at + 16 : at + 16 + size], decompressed_size=(n >> 4) * kind.itemsize, codec="zstd", asbytes=True)
        out.append(np.frombuffer(raw, kind).astype(np.int64))
        at += 16 + size
    return out


_ROWS = "batch long, bucket int, data binary, counts binary, kind int"


def _row(batch: int, kind: int, bucket: int, data: bytes, counts: bytes = b"") -> pa.RecordBatch:
    columns = [pa.array([batch], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.array([counts], pa.binary()), pa.array([kind], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "bucket", "data", "counts", "kind"])


def _held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def pairs_of(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs last << 16 | id of documents laid end to end, and the place of each position's pair."""
    last = np.concatenate([[end], ids[:-1]])
    last[np.cumsum(sizes)[:-1]] = end
    seen = np.zeros(end + 1, bool)
    seen[ids] = seen[end] = True
    present = np.flatnonzero(seen)
    n = len(present)
    small = np.zeros(end + 1, np.int64)
    small[present] = np.arange(n)
    keys = small[last] * n + small[ids]
    if n * n > DENSE:
        found, place = np.unique(keys, return_inverse=True)
    else:
        flags = np.zeros(n * n, bool)
        flags[keys] = True
        found = np.flatnonzero(flags)
        table = np.empty(n * n, np.int32)
        table[found] = np.arange(len(found))
        place = table[keys]
    return present[found // n] << 16 | present[found % n], place


def pair_buckets(pairs: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Buckets of pairs: those of one last id and one class are together."""
    return (mix64(((pairs >> 16) << 16 | group[pairs & 0xFFFF]).astype(np.uint64) * MIX) % np.uint64(width)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(width + 1))
    for b in range(width):
        if bounds[b + 1] > bounds[b]:
            yield b, order[bounds[b] : bounds[b + 1]]


def scan(docs: DataFrame, folds: int, ranks: dict[bytes, int], pattern: str, width: int) -> DataFrame:
    """Rows of every kind but pairs, of batches of documents."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ordinal, task = Tokens(ranks, pattern), 0, TaskContext.get().partitionId()
        counts = np.zeros(len(ranks) + 1, np.int64)

        def send(ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
            nonlocal ordinal
            batch, ordinal = task << 24 | ordinal, ordinal + 1
            subwords = list(map(tokens, texts))
            sizes = np.array([len(x) for x in subwords], np.int64)
            seeds = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=0 if i is None else i & 0xFFFFFFFFFFFFFFFF) >> 1 for i, x in zip(ids, subwords)], np.int64)
            hide, flat = ~np.array(held, bool), np.concatenate(subwords)
            counts[:] += np.bincount(flat[np.repeat(hide, sizes)], minlength=len(counts))
            yield _row(batch, TOKENS, 0, _packed(flat), _packed(np.array(held, np.int64)) + _packed(sizes) + _packed(seeds))
            del subwords, flat
            index, refs, ptr = _Index(), [], [0]
            for text in texts:
                refs += map(index.__getitem__, words_of(text))
                ptr.append(len(refs))
            refs, spans = np.array(refs, np.int64), np.diff(ptr)
            vocab = list(index)
            bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab)) % np.uint64(width)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(vocab), np.int64)
            place[order] = np.arange(len(vocab))
            flat = place[refs]
            n = np.bincount(flat[np.repeat(hide, spans)], minlength=len(vocab))
            bounds = np.searchsorted(bucket[order], np.arange(width + 1))
            vocab = list(map(vocab.__getitem__, order.tolist()))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = bounds[b], bounds[b + 1]
                yield _row(batch, WORDS, b, b" ".join(vocab[lo:hi]), _packed(n[lo:hi]))
            keys, times = np.unique(np.repeat(np.arange(len(texts)), spans) * (len(vocab) + 1) + flat, return_counts=True)
            head = [
                np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.int64), np.array(held, np.int64), spans,
                np.bincount(keys // (len(vocab) + 1), minlength=len(texts)), keys % (len(vocab) + 1), times,
            ]
            yield _row(batch, HEADS, 0, b"".join(map(_packed, head)))

        ids, held, texts, size = [], [], [], 0
        for batch in (part for whole in batches for part in slices_of(whole)):
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t or "") + 64
                if size > BATCH_BYTES:
                    yield from send(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield from send(ids, held, texts)
        for part, piece in enumerate(np.array_split(counts, PARTS)):
            if piece.any():
                yield _row(-1, IDS, part, b"", _packed(piece))

    return docs.select("doc_id", "text", _held_out(folds).alias("held")).mapInArrow(per_task, _ROWS)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int]]:
    """(ids, held out, seed) of the documents of token rows."""
    for rows in (part for whole in batches for part in slices_of(whole, 1)):
        ids, (held, sizes, seeds) = _arrays(rows.column("data")[0].as_py())[0], _arrays(rows.column("counts")[0].as_py())
        yield from zip(np.split(ids, np.cumsum(sizes)[:-1]), held.tolist(), seeds.tolist())


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of the subword ids in the training documents. rows: of kind IDS."""

    def add(parts: pa.Table) -> pa.RecordBatch:
        return _row(-1, IDS, parts.column("bucket")[0].as_py(), b"", _packed(sum(_arrays(c)[0] for c in parts.column("counts").to_pylist())))

    pieces = np.array_split(np.zeros(size, np.int64), PARTS)
    for r in runs_in_partition(rows, ["bucket"], add, _ROWS).select("bucket", "counts").collect():
        pieces[r.bucket] = _arrays(r.counts)[0]
    return np.concatenate(pieces)


def train(tokens: DataFrame, vocabulary: Vocabulary, rows: int, end: int) -> Attention:
    """Attention weights from every training document of the token rows, of rows documents in all."""
    shards = min(SHARDS, max(1, -(-rows // (ROUNDS * SHARD_ROWS))))
    attention = Attention(vocabulary)

    def deal(turn: int):
        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for ids, out, seed in documents(batches):
                if not out and (seed >> 4) % ROUNDS == turn:
                    held.append(((seed >> 8) % shards, seed, _packed(ids)))
                if len(held) == 512:
                    yield _deal_batch(held)
                    held = []
            if held:
                yield _deal_batch(held)

        return per_task

    def learn(start: np.ndarray):
        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(start), np.int64), 0
            rows = ((shard, ids) for whole in batches for part in slices_of(whole) for shard, ids in zip(part.column("shard").to_pylist(), part.column("ids").to_pylist()))
            following = next(rows, None)
            while following:
                shard, own = following[0], Attention(vocabulary, start.copy())

                def mine() -> Iterator[np.ndarray]:
                    nonlocal following
                    while following and following[0] == shard:  # noqa: B023
                        yield _arrays(following[1])[0]
                        following = next(rows, None)

                own.train(mine(), end)
                total += np.rint(own.flat.astype(float) * FIXED).astype(np.int64)
                n += 1
            for part, piece in enumerate(np.array_split(total, PARTS) if n else []):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["part", "n", "weights"])

        return per_task

    def add(parts: pa.Table) -> pa.RecordBatch:
        total = sum(np.frombuffer(c, np.int64) for c in parts.column("weights").to_pylist())
        return pa.RecordBatch.from_arrays([parts.column("part")[:1].combine_chunks(), pa.array([sum(parts.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "weights"])

    fields = "part int, n long, weights binary"
    for turn in range(ROUNDS):
        dealt = tokens.mapInArrow(deal(turn), "shard long, seed long, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "seed")
        learnt = sorted(runs_in_partition(dealt.mapInArrow(learn(attention.flat), fields), ["part"], add, fields).collect(), key=lambda r: r.part)
        if learnt:
            attention = Attention(vocabulary, np.concatenate([np.frombuffer(r.weights, np.int64) / (r.n * FIXED) for r in learnt]))
    return attention


def _deal_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, seed, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(seed, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "seed", "ids"])


def _meet_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of one partition's buckets from all batches: their total counts go back."""
    asked, totals, counts = [], {}, []
    for part in parts:
        for batch, bucket, words, n in zip(*(part.column(c).to_pylist() for c in ("batch", "bucket", "data", "counts"))):
            asked.append((batch, bucket, np.array([totals.setdefault(w, len(totals)) for w in words.split(b" ")], np.int32)))
            counts += _arrays(n)
    if not asked:
        return
    total = np.zeros(len(totals), np.int64)
    for (_, _, at), n in zip(asked, counts):
        total[at] += n
    yield _row(-1, WORDS, -1, b"", _packed(np.array([total.sum(), (total > 0).sum()])))
    for batch, bucket, at in asked:
        yield _row(batch, WORDS, bucket, b"", _packed(total[at]))


def pair_logs(tokens: DataFrame, vocabulary: Vocabulary, end: int, width: int) -> DataFrame:
    """Rows of kind PAIRS: the log10 probabilities inside the class of the distinct pairs of each batch, by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for whole in batches for part in slices_of(whole, 1)):
            ids, (held, sizes, _) = _arrays(rows.column("data")[0].as_py())[0], _arrays(rows.column("counts")[0].as_py())
            pairs, place = pairs_of(ids, sizes, end)
            n = np.bincount(place[np.repeat(held == 0, sizes)], minlength=len(pairs))
            for b, own in _by_bucket(pair_buckets(pairs, vocabulary.group, width), width):
                yield _row(rows.column("batch")[0].as_py(), PAIRS, b, _packed(np.diff(pairs[own], prepend=0)), _packed(n[own]))

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(batch, bucket, np.cumsum(_arrays(d)[0]).astype(np.uint32), _arrays(n)[0]) for part in parts for batch, bucket, d, n in zip(*(part.column(c).to_pylist() for c in ("batch", "bucket", "data", "counts")))]
        if not asked:
            return
        pairs, place = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([x[3] for x in asked]))  # sums of integers, exact in doubles
        pairs = pairs.astype(np.int64)
        context, of = np.unique((pairs >> 16) << 16 | vocabulary.group[pairs & 0xFFFF], return_inverse=True)
        logs = vocabulary.inside(pairs & 0xFFFF, n, np.bincount(of, weights=n, minlength=len(context))[of]).astype(np.float32)
        lo = 0
        for batch, bucket, keys, _ in asked:
            yield _row(batch, PAIRS, bucket, logs[place[lo : lo + len(keys)]].tobytes())
            lo += len(keys)

    return tokens.mapInArrow(ask, _ROWS).repartition(width, "bucket").mapInArrow(meet, _ROWS)


def _sums(logs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of stretches in units of 1 / FIXED, so that they do not depend on the order of the additions."""
    return np.add.reduceat(np.rint(logs * FIXED).astype(np.int64), starts) / FIXED


@dataclass
class Fitted:
    """What score needs: the scanned rows, the tables by id and the weights."""

    rows: DataFrame
    vocabulary: Vocabulary
    attention: Attention
    end: int
    width: int

    def of(self, kind: int) -> DataFrame:
        return self.rows.where(F.col("kind") == kind)


def fit(docs: DataFrame, folds: int = 10, vocabulary: tuple[dict[bytes, int], str] | None = None) -> Fitted:
    """Scan the documents and learn from the training ones."""
    ranks, pattern = vocabulary or default_vocabulary()
    if len(ranks) >= 1 << 16:
        raise ValueError("the subword vocabulary must have fewer than 65536 ids")
    n_rows = docs.count()
    width, end = shuffle_width(docs.sparkSession, n_rows), len(ranks)
    rows = cut(scan(docs, folds, ranks, pattern, width), "kind")
    fitted = Fitted(rows, None, None, end, width)
    fitted.vocabulary = Vocabulary.of(id_counts(fitted.of(IDS), end + 1))
    fitted.attention = train(fitted.of(TOKENS), fitted.vocabulary, n_rows, end)
    return fitted


def score(docs: DataFrame, folds: int = 10, vocabulary: tuple[dict[bytes, int], str] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    fitted = fit(docs, folds, vocabulary)
    width, end, tables, attention = fitted.width, fitted.end, fitted.vocabulary, fitted.attention
    replies = cut(fitted.of(WORDS).repartition(width, "bucket").mapInArrow(_meet_words, _ROWS))
    delete(docs.sparkSession, f"{fitted.rows.table_path}/kind={WORDS}")  # counted and answered
    ends = docs.where(~_held_out(folds)).count()
    stats = [_arrays(r.counts)[0] for r in replies.where("batch = -1").select("counts").collect()]
    n = int(sum(s[0] for s in stats)) + ends
    v = int(sum(s[1] for s in stats)) + (1 if ends else 0)
    divisor = np.log10(n + 0.1 * (v + 1))

    def finish(rows: pa.Table) -> pa.RecordBatch:
        kinds, buckets = rows.column("kind").to_numpy(), rows.column("bucket").to_numpy()
        data, counts = rows.column("data"), rows.column("counts")

        def in_order(kind: int) -> list[int]:
            at = np.flatnonzero(kinds == kind)
            return at[np.argsort(buckets[at], kind="stable")].tolist()

        ids, known_id, held_out, n_words, spans, refs, times = _arrays(data[in_order(HEADS)[0]].as_py())
        words = in_order(WORDS)
        c = np.concatenate([_arrays(counts[i].as_py())[0] for i in words]) if words else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(ids)), spans)
        base = np.bincount(doc, weights=times * np.log10(c[refs] + 0.1), minlength=len(ids)) + np.log10(ends + 0.1) - (n_words + 1) * divisor
        known = np.bincount(doc, weights=times * (c[refs] > 0), minlength=len(ids)).astype(np.int64) + (1 if ends else 0)
        at = in_order(TOKENS)[0]
        subwords, sizes = _arrays(data[at].as_py())[0], _arrays(counts[at].as_py())[1]
        inputs, targets, starts = lay(subwords, sizes, end)
        scores = _sums(attention.log10(inputs, targets, end), starts)
        pairs, place = pairs_of(subwords, sizes, end)
        logs = np.empty(len(pairs))
        logs[np.argsort(pair_buckets(pairs, tables.group, width), kind="stable")] = np.concatenate([np.frombuffer(data[i].as_py(), np.float32) for i in in_order(PAIRS)])
        scores += _sums(logs[place], np.cumsum(sizes) - sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=known_id == 0), pa.array(held_out == 1), pa.array(n_words + 1), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(scores), pa.array(sizes)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"],
        )

    inside = cut(pair_logs(fitted.of(TOKENS), tables, end, width))
    names = [c.split()[0] for c in _ROWS.split(", ")]
    together = fitted.of(HEADS).select(names).union(fitted.of(TOKENS).select(names)).union(replies.where("batch >= 0").select(names)).union(inside.select(names))
    return runs_in_partition(together, ["batch"], finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long")
