import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docspan.llm import attention as A
from docspan.llm import lm
from tests.llm.fixtures import documents, words_of


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_scores(rows, fitted):
    """The model read off its definition: loops over positions, counts in dictionaries, doubles."""
    tokens, v, end = lm.Tokens(*lm.default_vocabulary()), fitted.vocabulary, fitted.end
    w = {k: x.astype(float) for k, x in fitted.attention.w.items()}
    docs = [(r, tokens(r.text).tolist()) for r in rows]
    pairs, after = Counter(), Counter()
    for r, ids in docs:
        if not held(r.doc_id):
            for last, x in zip([end, *ids], ids):
                pairs[last, x] += 1
                after[last, int(v.group[x])] += 1
    out = []
    for r, ids in docs:
        total, inputs = 0.0, [end, *ids[:-1]]
        x = w["e"][v.slot[[end] * A.BLOCK + inputs]]
        q, k, val, own = np.split(x @ w["in"], [A.HEAD, 2 * A.HEAD, 2 * A.HEAD + A.WIDTH], axis=1)
        for i, target in enumerate(ids):
            row, lo = i % A.BLOCK, i - i % A.BLOCK  # the window starts a block earlier, which padding shifts to lo
            seen = range(lo, i + A.BLOCK + 1)
            a = np.exp([min(30.0, q[i + A.BLOCK] @ k[j] + w["p"][row, j - lo]) for j in seen])
            o = sum(p * val[j] for p, j in zip(a / a.sum(), seen))
            y = np.maximum(own[i + A.BLOCK] + o @ w["o"] + w["h"], 0)
            g = np.exp(np.clip(y @ w["c"] + w["b"], -30, 30))
            c = int(v.group[target])
            total += math.log10(g[c] / g.sum()) + math.log10((pairs[inputs[i], target] + A.SMOOTHING * v.share[target]) / (after[inputs[i], c] + A.SMOOTHING))
        out.append((r.doc_id, total))
    return out


def test_score_equals_a_plain_reading_of_the_model(spark):
    docs = documents(spark, clash=True)
    rows = [r for r in docs.collect() if len(r.text or "") < 3000]
    fitted = lm.fit(docs)
    every = docs.collect()
    want = dict(zip([(r.doc_id, r.text) for r in every], [s for _, s in plain_scores(every, fitted)]))
    got = {(r.doc_id, n): r for r, n in ((r, None) for r in lm.score(docs).collect())}
    for r in rows:
        assert got[r.doc_id, None].score == pytest.approx(want[r.doc_id, r.text], rel=1e-4, abs=1e-3)


def test_base(spark):
    docs = documents(spark, clash=True)
    rows = docs.collect()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in [*words_of(r.text), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id, held(r.doc_id), len(t := [*words_of(r.text), None]), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r in rows)
    got = lm.score(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.n_subwords >= 1 for r in got)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(lm, "SHARD_ROWS", 4)
    found = []
    for parts, width, size in ((1, 4, 4 << 20), (8, 3, 4 << 20), (29, 7, 2_000)):
        monkeypatch.setattr(lm, "shuffle_width", lambda *_, n=width: n)
        monkeypatch.setattr(lm, "BATCH_BYTES", size)
        found.append(sorted((r.doc_id, r.n_subwords, r.score, round(r.base_score, 9)) for r in lm.score(docs.repartition(parts)).collect()))
    assert found[0] == found[1] == found[2]


def test_edges(spark):
    assert lm.score(documents(spark, [])).count() == 0
    fields = "doc_id long, text string"
    out = [i for i in range(100) if held(i)][:3]
    rows = lm.score(spark.createDataFrame([(out[0], "a b"), (out[1], None), (out[2], "a b")], fields)).collect()  # no training rows
    assert {r.train_tokens for r in rows} == {0} and len({r.score for r in rows if r.n_tokens == 3}) == 1
    rows = lm.score(spark.createDataFrame([(None, "a b"), (None, "a b"), (out[0], "")], fields)).collect()
    assert len(rows) == 3 and [r.held_out for r in rows if r.doc_id is None] == [False, False] and all(r.score < 0 for r in rows)


def test_a_very_long_text_is_scored_in_chunks(spark, monkeypatch):
    seen = []
    forward = A.Attention._forward
    monkeypatch.setattr(A.Attention, "_forward", lambda self, slots: seen.append(len(slots)) or forward(self, slots))
    v = A.Vocabulary.of(np.arange(100.0))
    a = A.Attention(v)
    inputs, targets, _ = A.layout([np.arange(50_000) % 99], 99)
    assert np.count_nonzero(a.log10(inputs, targets, 99)) == 50_000 and max(seen) == A.CHUNK + A.BLOCK
    rows = lm.score(spark.createDataFrame([(1, "word and more " * 100_000), (2, "x" * 300_000)], "doc_id long, text string")).collect()
    assert {r.n_tokens for r in rows} == {300_001, 2}


def small(vocabulary=40):
    v = A.Vocabulary.of(np.random.default_rng(3).integers(0, 200, vocabulary).astype(float))
    a = A.Attention(v)
    a.w["c"][:] = np.random.default_rng(4).normal(0, 0.3, a.w["c"].shape)
    return v, a


def test_distributions_sum_to_one():
    v, a = small()
    docs = [np.array([5, 7, 11, t], np.int32) for t in range(40)]
    inputs, targets, starts = A.layout(docs, 39)
    classes = a.log10(inputs, targets, 39)[starts + 3]
    n = np.random.default_rng(5).integers(0, 9, 40)
    inside = v.inside(np.arange(40), n, np.bincount(v.group, weights=n)[v.group])
    assert (10 ** (classes + inside)).sum() == pytest.approx(1, abs=1e-5)


def test_each_id_is_scored_once_and_causally():
    _, a = small()
    docs = [np.arange(n, dtype=np.int32) % 39 for n in (1, 7, 8, 9, 50, 9000)]
    inputs, targets, starts = A.layout(docs, 39)
    assert [int(x) for x in targets[targets >= 0]] == [int(x) for d in docs for x in d]
    logs = a.log10(inputs, targets, 39)
    assert np.count_nonzero(logs) == sum(map(len, docs))
    alone = [a.log10(*A.layout([d], 39)[:2], 39).sum() for d in docs]
    assert np.add.reduceat(logs, starts) == pytest.approx(alone, rel=1e-12)
    changed = docs[4].copy()
    changed[30] = 7
    i2, t2, s2 = A.layout([changed], 39)
    before = a.log10(*A.layout([docs[4]], 39)[:2], 39)
    assert np.array_equal(a.log10(i2, t2, 39)[s2[0] : s2[0] + 30], before[s2[0] : s2[0] + 30])


def test_gradient():
    v, a = small()
    docs = [np.random.default_rng(1).integers(0, 40, 45).astype(np.int32)]
    inputs, targets, _ = A.layout(docs, 39)
    _, g = a.gradient(inputs, targets)
    r = np.random.default_rng(2)
    for at in r.choice(np.flatnonzero(np.abs(g) > 1e-3), 25, replace=False):
        plus, minus = a.flat.copy(), a.flat.copy()
        plus[at] += 3e-3
        minus[at] -= 3e-3
        slope = (A.Attention(v, plus).gradient(inputs, targets)[0] - A.Attention(v, minus).gradient(inputs, targets)[0]) / 6e-3
        assert slope == pytest.approx(g[at], rel=0.08, abs=4e-4)


def test_training_reads_every_id_and_helps():
    _, a = small()
    docs = [np.cumsum(np.random.default_rng(i).integers(0, 3, n)).astype(np.int32) % 39 for i, n in enumerate((20_000, 3, 500, 9_000))]
    seen = np.concatenate([t[A.BLOCK :] for _, t in A.training_chunks(iter(docs), 39)])
    assert [int(x) for x in seen[seen >= 0]] == [int(x) for d in docs for x in d]
    inputs, targets, _ = A.layout(docs, 39)
    before = a.log10(inputs, targets, 39).sum()
    for _ in range(5):
        a.train(iter(docs), 39)
    assert a.log10(inputs, targets, 39).sum() > before + 0.3 * abs(before)


def test_pairs_of_batches(monkeypatch):
    ids, sizes = np.random.default_rng(1).integers(0, 50, 500), np.array([200, 1, 299])
    last = np.concatenate([[60], ids[:-1]])
    last[[200, 201]] = 60
    for limit in (1 << 24, 10):
        monkeypatch.setattr(lm, "DENSE", limit)
        pairs, place = lm.pairs_of(ids, sizes, 60)
        assert np.array_equal(pairs[place], last << 16 | ids) and np.array_equal(pairs, np.unique(pairs))


def test_packed_arrays():
    parts = [np.array([1, 65_535]), np.array([-1, 70_000]), np.array([1 << 40]), np.zeros(0, np.int64)]
    assert [x.tolist() for x in lm._arrays(b"".join(map(lm._packed, parts)))] == [x.tolist() for x in parts]


def test_training_fills_every_chunk_but_the_last(monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 64)
    docs = [np.arange(n, dtype=np.int32) % 39 for n in [700, 3, 90, 8, 1300, 513, 1, 16] * 3]
    inputs, targets, _ = A.layout(docs, 39)
    found = list(A.training_chunks(iter(docs), 39))
    assert len(found) == -(-(len(inputs) - A.BLOCK) // 64)
    for at, whole in ((0, inputs), (1, targets)):
        laid = np.concatenate([c[at][A.BLOCK :] for c in found])[: len(whole) - A.BLOCK]
        assert np.array_equal(laid, whole[A.BLOCK :]) and all(np.array_equal(c[at][: A.BLOCK], whole[i * 64 : i * 64 + A.BLOCK]) for i, c in enumerate(found))


def test_exponents_are_cut_at_thirty():
    """Where a sum shows exponents beyond 30, these are cut, as by the definition."""
    v, a = small()
    a.w["in"][:, : 2 * A.HEAD] *= 12
    a.w["c"][:, 3] *= 200
    docs = [np.random.default_rng(6).integers(0, 39, 9).astype(np.int32) for _ in range(300)]
    inputs, targets, starts = A.layout(docs, 39)
    got = a.log10(inputs, targets, 39)
    w = {k: x.astype(float) for k, x in a.w.items()}
    x = w["e"][v.slot[inputs]]
    q, k, val, own = np.split(x @ w["in"], [A.HEAD, 2 * A.HEAD, 2 * A.HEAD + A.WIDTH], axis=1)
    cut = [0, 0]
    for i in np.flatnonzero(targets >= 0)[:400]:
        lo = i - i % A.BLOCK - A.BLOCK
        s = q[i] @ k[lo : i + 1].T + w["p"][i % A.BLOCK, : i + 1 - lo]
        e = np.exp(np.minimum(s, 30))
        g = np.maximum(own[i] + e / e.sum() @ val[lo : i + 1] @ w["o"] + w["h"], 0) @ w["c"] + w["b"]
        cut[0] += s.max() > 30
        cut[1] += np.abs(g[: len(v.mass)]).max() > 30
        g = np.clip(g, -30, 30)
        assert got[i] == pytest.approx((g[v.group[targets[i]]] - np.log(np.exp(g).sum())) / np.log(10), abs=2e-4)
    assert min(cut) > 0 and max(cut) < 400, cut


def test_subwords_equal_the_encoding_with_special_tokens():
    tokens = lm.Tokens(*lm.default_vocabulary())
    for text in ("", "a", "  two  spaces \n\n\t end ", "I'll we've '  's", "\u4e2d\u6587 \u0435\u0449\u0451 \U0001f600 \u00a0x\u3000", "<|endoftext|> <|im_end|>", "1234 5,6.7!!"):
        assert tokens(text).tolist() == [*tokens.encoding.encode(text, disallowed_special=()), tokens.end] and tokens(text).dtype == np.int32


def test_embedding_gradients_are_added_in_pairs_with_the_same_bits():
    r = np.random.default_rng(8)
    slots, g = r.integers(0, 50, 3000), r.normal(size=(3000, A.WIDTH)).astype(np.float32)
    want, got = np.zeros((A.SLOTS, A.WIDTH), np.float32), np.zeros(A.SLOTS * A.WIDTH, np.float32)
    for slot, row in zip(slots, g):
        want[slot] += row
    np.add.at(got.view(np.complex64), A._CELLS.take(slots, 0).reshape(-1), g.reshape(-1).view(np.complex64))
    assert np.array_equal(got.reshape(want.shape), want)
