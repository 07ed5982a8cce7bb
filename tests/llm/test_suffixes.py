import hashlib
from collections import Counter

import pytest

from docspan.llm import suffixes
from tests.llm.fixtures import documents


def brute(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def compare(docs):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect())
    assert got == want
    return got


def test_equals_brute_force(spark):
    got = compare(documents(spark, clash=True))
    assert any(0 < r[2] < r[1] for r in got)


def test_split_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 3)
    compare(documents(spark))


def test_real_sample(spark, sf_dir):
    compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_empty_table(spark):
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0


def test_texts_in_stretches(monkeypatch):
    import numpy as np

    raw = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole = suffixes.text_runs(raw)
    assert whole[1].sum() == len(raw) - 199
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    parts = suffixes.text_runs(raw)
    assert parts[1].sum() == len(raw) - 199 and set(whole[2]) == set(parts[2])


def lcp(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("n", "letters", "steps"), [(50, 2, 64), (700, 2, 64), (3000, 1, 7), (3000, 3, 64), (1, 2, 64), (900, 2, 1)])
def test_suffix_order_and_kasai(n, letters, steps, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixes, "STEPS", steps)
    r = np.random.default_rng(n)
    text = r.integers(97, 97 + letters, n, dtype=np.uint8)
    if letters == 3:  # long repeats
        text = np.concatenate([text, text[100:900], text[:700], text[100:900]])
    raw = text.tobytes()
    order = suffixes.sorted_suffixes(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    keys = [raw[i : i + 200] for i in order]
    assert keys == sorted(keys)
    got = suffixes.kasai(suffixes.eight_bytes(text), order)[order]
    assert got.tolist() == [0, *(lcp(a, b) for a, b in zip(keys, keys[1:]))]


def test_hot_anchor_and_rows_without_doc_id(spark, monkeypatch):
    from docspan.llm import text

    monkeypatch.setattr(text, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(text, "HOT_ROWS", 2)
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 5)
    common = "the passage that many documents share, " * 6
    rows = [(i if i % 7 else None, f"lead {i} " + common + f" tail {i * i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute([t for _, t in rows]))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()) == want


def test_a_very_long_text(spark):
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(3000)]
    long = " ".join(r.choices(words, k=500_000))
    docs = spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_500])], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffixes.remove_repeats(docs).collect()}
    assert got == {1: (500, 1), 2: (500, 1)}
