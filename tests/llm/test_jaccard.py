from fractions import Fraction

import pytest

from docspan.llm import jaccard
from tests.llm.fixtures import documents, words_of


def brute(rows, k, p, q):
    sets = {}
    for doc_id, text in rows:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "p", "q"), [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_equals_brute_force(spark, k, p, q):
    docs = documents(spark, clash=True)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, p, q)
    rows = jaccard.jaccard_components(docs, k, Fraction(p, q)).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def brute_links(rows, k, p, q):
    """doc_id -> (linked documents, different linked sets); rows: (doc_id, text)."""
    sets = []
    for doc_id, text in rows:
        w = words_of(text)
        sets.append((doc_id, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    out = {}
    for i, (doc_id, a) in enumerate(sets):
        others = [b for j, (_, b) in enumerate(sets) if i != j and a and b and q * len(a & b) >= p * len(a | b)]
        out[doc_id] = len(others), len(set(others) - {a})
    return out


def group_of_near_copies(n, seed=2):
    import random

    r = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(120), r.randint(0, 6)):
            w[i] = f"m{r.random()}"
        rows.append(" ".join(w[: r.randint(95, 120)]))
    return rows


@pytest.mark.parametrize("block", [256, 20])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = group_of_near_copies(150)
    docs = documents(spark, [*rows, *rows[:30], None, "", "a b"], clash=True)
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_links, r.set_links) for r in jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()}
    assert got == brute_links(data, 4, 85, 100) and max(n for n, _ in got.values()) > 20


def test_without_broadcasts(spark, monkeypatch):
    from docspan.llm import text

    for name in ("BROADCAST_ROWS", "HOT_ROWS"):
        monkeypatch.setattr(text, name, 2)
    monkeypatch.setattr(jaccard, "BROADCAST_MEMBERS", 2)
    docs = documents(spark, [*["one two three four five six"] * 40, *group_of_near_copies(60), *[None] * 40])
    want = brute([(r.doc_id, r.text) for r in docs.distinct().collect()], 4, 85, 100)
    rows = jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == docs.count()


def test_rows_without_doc_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " x"), (7, base + " y"), (None, "alone here"), (9, base)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.n_links) for r in got) == [(0, 1, 0, 0), (0, 57, 7, 3), (0, 58, 7, 3), (7, 58, 7, 3), (9, 57, 7, 3)]


def test_a_very_long_text_and_the_threshold_itself(spark):
    long = " ".join(f"v{i}" for i in range(300_000))
    ties = [" ".join(f"a{i}" for i in range(20)), " ".join(f"a{i}" for i in range(17))]  # 1-word sets: 17 / 20 = 0.85
    docs = documents(spark, [long, long + " end", *ties, " ".join(ties[1].split()[:16])])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 1, Fraction(85, 100)).collect()}
    assert got == {1: 1, 4: 1, 7: 7, 10: 7, 13: 7}


def test_hub_links_connect_each_group():
    import numpy as np

    from docspan.llm.text import hub_links

    group = np.repeat([1, 2, 3], [1, 5000, 70])
    ids = np.arange(len(group))
    links = hub_links(ids, group)
    assert np.bincount(links.ravel()).max() <= 64 * 3 and (group[links[:, 0]] == group[links[:, 1]]).all()
    label = np.arange(len(ids))
    for _ in range(10):
        for a, b in links.tolist():
            label[a] = label[b] = min(label[a], label[b])
    assert len(set(label.tolist())) == 3


def test_empty_table(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_real_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()}
    assert got == want and any(i != c for i, (_, c) in got.items())


def test_large_group_is_split_into_tiles(spark):
    import random

    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(400):
        w = list(base)
        for i in r.sample(range(120), r.randint(0, 6)):
            w[i] = f"m{r.random()}"
        rows.append(" ".join(w))
    docs = documents(spark, rows)
    want = brute([(r.doc_id, r.text) for r in docs.distinct().collect()], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()}
    assert got == want
