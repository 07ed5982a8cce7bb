"""A causal self-attention language model in numpy, over subword ids.

The text is cut into blocks of BLOCK positions. A block attends, causally masked, to itself and to the block
before it, so windows of two blocks overlap by half and every position is scored exactly once with BLOCK to
2 * BLOCK ids of context; all blocks of a chunk are one batch. The attention output and the last id go through a
hidden layer and an output projection, whose softmax is the distribution of the next id's class. Classes cut the
vocabulary, ordered by count, into parts of about equal mass; frequent ids are classes of their own. Inside a class
an id has the probability that exact counts give it after the last id, smoothed by its unigram share, so

    p(id | context) = softmax(hidden @ c + b)[class(id)] * (n(last, id) + K * u(id)) / (n(last, class) + K)

where u is normalised inside the class. Both factors sum to 1.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 8  # scored positions of a window; it spans two blocks
WIDTH = 16  # of embeddings, values and the hidden layer
HEAD = 8  # of queries and keys
SLOTS = 2048  # embedding rows; rarer ids share the last quarter
CLASSES = 64  # of the output projection, at most
SMOOTHING = 4.0  # K: pseudo-counts of the unigram share inside a class
CHUNK = 2048  # positions that are scored or trained on together
RATE = 0.01
TINY = np.float32(1e-18)
NONE = -60.0  # log odds of a class without ids
LEAST = np.float32(np.exp(-30))  # odds of a class


def reuse_memory() -> None:
    """Let the process keep the memory of freed arrays: mapping fresh pages for every array costs a fifth of the time."""
    try:
        ctypes.CDLL(None).mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


@dataclass
class Vocabulary:
    """Tables by id, from the counts over all training documents."""

    slot: np.ndarray  # embedding row
    group: np.ndarray  # class
    share: np.ndarray  # unigram probability inside the class
    mass: np.ndarray  # unigram probability of each class

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        place = np.arange(len(counts))
        own = SLOTS * 3 // 4
        slot, group = np.empty(len(counts), np.int32), np.empty(len(counts), np.int32)
        slot[order] = np.where(place < own, place, own + place % (SLOTS - own))
        p = counts + 0.1
        p = p / p.sum()
        before = np.cumsum(p[order]) - p[order]
        part = np.minimum((before * CLASSES).astype(np.int64), CLASSES - 1)
        group[order] = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
        mass = np.bincount(group, weights=p)
        return cls(slot, group, p / mass[group], mass)

    def inside(self, ids: np.ndarray, pairs: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 probability of ids inside their class. pairs: n(last, id); after: n(last, class)."""
        return np.log10((pairs + SMOOTHING * self.share[ids]) / (after + SMOOTHING))


def layout(docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (-1: padding) and the first scored position of each document, in whole blocks.

    Each document starts with a block of padding, so that its first window sees no other document.
    """
    return lay(np.concatenate(docs), np.array([len(d) for d in docs]), end)


def lay(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """layout of documents that lie end to end already."""
    spans = (sizes + BLOCK - 1) // BLOCK * BLOCK + BLOCK
    starts = np.cumsum(spans) - spans + BLOCK
    before = np.cumsum(sizes) - sizes
    inputs, targets = np.full(spans.sum(), end, np.int32), np.full(spans.sum(), -1, np.int32)
    targets[np.repeat(starts - before, sizes) + np.arange(len(ids))] = ids
    np.copyto(inputs[1:], targets[:-1], where=targets[:-1] >= 0)
    after = starts + sizes  # nothing follows a document's last id
    inputs[after[after < len(inputs)]] = end
    return inputs, targets, starts


def chunks(inputs: np.ndarray, targets: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CHUNK positions at a time behind the block before them, which is context only; the last is filled up.

    All chunks have one shape, so what a position gets does not depend on its neighbours in the batch.
    """
    for lo in range(BLOCK, max(len(inputs), BLOCK + 1), CHUNK):
        i, t = inputs[lo - BLOCK : lo + CHUNK], targets[lo - BLOCK : lo + CHUNK]
        short = CHUNK + BLOCK - len(i)
        yield (np.concatenate([i, np.full(short, end, np.int32)]), np.concatenate([t, np.full(short, -1, np.int32)])) if short else (i, t)


_MASK = np.where(np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e9).astype(np.float32)
_ONES = np.ones((2 * BLOCK, 1), np.float32)
_CELLS = np.arange(SLOTS * WIDTH // 2).reshape(SLOTS, -1)  # of pairs of weights
_MOST = np.float32(np.exp(30))


class Attention:
    """One causal head over two blocks, a hidden layer and the output projection."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        self.vocabulary = vocabulary
        empty = -len(vocabulary.mass) % 16  # products are faster over whole sixteens; a class more has no ids and odds of NONE
        n = len(vocabulary.mass) + empty
        self.shapes = {"e": (SLOTS, WIDTH), "in": (WIDTH, 2 * HEAD + 2 * WIDTH), "o": (WIDTH, WIDTH), "h": (WIDTH,), "p": (BLOCK, 2 * BLOCK), "c": (WIDTH, n), "b": (n,)}
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes.values()]).tolist()
        self.places = dict(zip(self.shapes, zip([0, *ends], ends)))
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat.astype(np.float32)
        self.table = None  # while texts are scored: e @ in
        self.w = self._views(self.flat)
        if flat is None:  # the projection starts at the class unigram
            random = np.random.default_rng(7)
            for name in ("e", "in", "o"):
                self.w[name][:] = random.normal(0, 0.3, self.shapes[name])
            self.w["b"][:] = np.concatenate([np.log(vocabulary.mass), np.full(empty, NONE)])

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of flat by name."""
        return {name: flat[lo:hi].reshape(self.shapes[name]) for name, (lo, hi) in self.places.items()}

    def _forward(self, slots: np.ndarray) -> tuple:
        """Activations of every block but the first (x: of all), the odds of the classes but for the factor exp(b), and the sums of the odds.

        One product gives queries, keys, values and the last id's own way to the hidden layer. Exponents are cut to
        30 (and those of classes to -30) only where a sum shows that one lies beyond.
        """
        w = self.w
        x = w["e"].take(slots, 0) if self.table is None else None
        into = x @ w["in"] if self.table is None else self.table.take(slots, 0)
        rows, step = into.strides

        def windows(lo: int, n: int) -> np.ndarray:
            return np.ndarray((len(into) // BLOCK - 1, 2 * BLOCK, n), into.dtype, into, lo * step, (rows * BLOCK, rows, step))

        q = into.reshape(-1, BLOCK, into.shape[1])[1:, :, :HEAD]
        k, v = windows(HEAD, HEAD), windows(2 * HEAD, WIDTH)
        keys = np.ascontiguousarray(k.transpose(0, 2, 1))  # the copy costs less than a product over strides
        a = q @ keys
        a += w["p"] + _MASK
        with np.errstate(over="ignore"):
            np.exp(a, out=a)
            total = a.reshape(-1, 2 * BLOCK) @ _ONES
        if not total.max() < _MOST:
            beyond = np.flatnonzero(~(total.reshape(-1, BLOCK) < _MOST).all(1))
            a[beyond] = np.exp(np.minimum(q[beyond] @ keys[beyond] + (w["p"] + _MASK), 30))
            total.reshape(-1, BLOCK)[beyond] = a[beyond].sum(2)
        a /= total.reshape(-1, BLOCK, 1)
        o = (a @ v).reshape(-1, WIDTH)
        y = o @ w["o"]
        y += into[BLOCK:, 2 * HEAD + WIDTH :]
        y += w["h"]
        np.maximum(y, np.zeros_like(y), out=y)  # a scalar takes three times as long
        g = y @ w["c"]
        bias = np.exp(w["b"])[:, None]
        with np.errstate(over="ignore"):
            np.exp(g, out=g)
            total = g @ bias
        if not (total.min() > 1e-4 and total.max() < _MOST):  # under 1e-4 an exp(-30) shows in the sum
            beyond = np.flatnonzero(~((total > 1e-4) & (total < _MOST)))
            odds = np.exp(np.clip((y[beyond, None] @ w["c"])[:, 0] + w["b"], -30, 30))  # row by row: the others keep theirs to the bit
            g[beyond], total[beyond, 0] = odds / bias[:, 0], odds.sum(1)
        return x, q, k, v, a, o, y, g, total

    def log10(self, inputs: np.ndarray, targets: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of the class of each position (0 at padding), a chunk at a time."""
        reuse_memory()
        out = np.zeros(len(targets))
        self.table = self.w["e"] @ self.w["in"]
        for n, (i, t) in enumerate(chunks(inputs, targets, end)):
            *_, g, total = self._forward(self.vocabulary.slot.take(i))
            at, cells, bias = self._cells(t[BLOCK:], g.shape[1])
            out[BLOCK + n * CHUNK + at] = np.log(np.maximum(g.reshape(-1).take(cells) * bias, LEAST) / total.take(at))
        self.table = None
        out *= np.log10(np.e)
        return out

    def _cells(self, targets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions that have a target, the places of their classes in rows of n, and the classes' exp(b)."""
        at = np.flatnonzero(targets >= 0)
        group = self.vocabulary.group.take(targets.take(at))
        return at, at * n + group, np.exp(self.w["b"]).take(group)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, want_loss: bool = True) -> tuple[float | None, np.ndarray]:
        """Mean negative log probability of the classes (where wanted), and its gradient."""
        w, slots = self.w, self.vocabulary.slot.take(inputs)
        x, q, k, v, a, o, y, g, total = self._forward(slots)
        t, flat = targets[BLOCK:], np.zeros_like(self.flat)
        grads = self._views(flat)
        at, cells, bias = self._cells(t, g.shape[1])
        n, odds = max(1, len(at)), g.reshape(-1)
        loss = float(-np.log(np.maximum(odds[cells] * bias, LEAST) / total[at, 0]).sum() / n) if want_loss else None
        g *= np.where(t >= 0, np.float32(1 / n), np.float32(0))[:, None] / total
        odds[cells] -= np.float32(1 / n) / bias  # g times exp(b) is the gradient; exp(b) joins the products
        factor = np.exp(w["b"])
        dy = g @ (w["c"] * factor).T
        dy *= y > 0
        ones = np.ones((1, len(g)), np.float32)
        grads["c"][:], grads["o"][:] = (g.T @ y).T * factor, o.T @ dy
        np.matmul(ones, dy, out=grads["h"][None])
        np.multiply(ones @ g, factor, out=grads["b"][None])
        do = (dy @ w["o"].T).reshape(-1, BLOCK, WIDTH)
        ds = do @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", do.reshape(o.shape), o).reshape(-1, BLOCK, 1)
        ds *= a
        np.matmul(ones[:, : len(ds)], ds.reshape(len(ds), -1), out=grads["p"].reshape(1, -1))
        seen = np.empty((len(ds), 2 * BLOCK, HEAD + WIDTH), np.float32)  # gradients of keys and values
        np.matmul(ds.transpose(0, 2, 1), q, out=seen[:, :, :HEAD])
        np.matmul(a.transpose(0, 2, 1), do, out=seen[:, :, HEAD:])
        into = np.empty((len(x) // BLOCK, BLOCK, 2 * HEAD + 2 * WIDTH), np.float32)
        into[0] = 0
        np.matmul(ds, k, out=into[1:, :, :HEAD])
        into[1:, :, HEAD:-WIDTH], into[1:, :, -WIDTH:] = seen[:, BLOCK:], dy.reshape(-1, BLOCK, WIDTH)
        into[:-1, :, HEAD:-WIDTH] += seen[:, :BLOCK]
        into = into.reshape(len(x), -1)
        np.matmul(x.T, into, out=grads["in"])
        pairs = (into @ w["in"].T).reshape(-1).view(np.complex64)  # two weights to an addition, each with the bits it has alone
        np.add.at(grads["e"].reshape(-1).view(np.complex64), _CELLS.take(slots, 0).reshape(-1), pairs)
        return loss, flat

    def train(self, docs: Iterable[np.ndarray], end: int, rate: float = RATE) -> None:
        """Adam over all ids of the documents in their order, each a target once.

        m and v are the moments times 10 and 50, which spares passes over the weights.
        """
        reuse_memory()
        m, v, part = (np.zeros_like(self.flat) for _ in range(3))
        for step, (inputs, targets) in enumerate(training_chunks(docs, end), 1):
            _, g = self.gradient(inputs, targets, want_loss=False)
            g += TINY  # moments of ids that do not come fade to this instead of numbers that processors are slow with
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.98)
            v += g
            np.sqrt(v, out=part)
            scale = 0.1 * rate / (1 - 0.9**step)
            part *= np.float32(math.sqrt(0.02 / (1 - 0.98**step)) / scale)
            part += np.float32(1e-8 / scale)
            np.divide(m, part, out=part)
            self.flat -= part


def training_chunks(docs: Iterable[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks over documents laid end to end; what does not fill one is carried on, so only the last is filled up."""
    held, size, rest = [], 0, ()

    def laid() -> tuple[np.ndarray, ...]:
        new = layout(held, end)[:2]
        return tuple(map(np.concatenate, zip(rest, new))) if rest else new

    for ids in docs:
        held.append(ids)
        size += len(ids)
        if size > 8 * CHUNK:
            inputs, targets = laid()
            whole = (len(inputs) - BLOCK) // CHUNK * CHUNK
            yield from chunks(inputs[: whole + BLOCK], targets[: whole + BLOCK], end)
            held, size, rest = [], 0, (inputs[whole:], targets[whole:])
    if held or rest and len(rest[0]) > BLOCK:
        yield from chunks(*(laid() if held else rest), end)
