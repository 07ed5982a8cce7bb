"""Queries against their SQL on tables made here, where the small shared ones hold too little to differ."""

import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from docspan.operators import papers, similarity, spatial
from docspan.plans import catalogue
from tests.oracle import same


def check(spark, folder, name, **tables):
    """The query equals its SQL on these tables (SQL texts that DuckDB runs)."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    same(catalogue.queries()[name](spark, str(folder)), con, catalogue.oracle_sql()[name])


def test_page_store_keeps_pages_of_equal_keys_apart(spark, tmp_path):
    check(spark, tmp_path, "page_store", supplier="select 9990 + i as s_suppkey from range(60) t(i)")


def test_line_index_of_more_than_9999_lines(spark, tmp_path):
    check(spark, tmp_path, "line_index", orders="select (i // 20) * 200 + i % 20 as o_orderkey, i * 7919 % 15000 as o_custkey from range(10050) t(i)")


def test_label_binding_makes_no_pairs_of_lines(spark, tmp_path):
    check(spark, tmp_path, "label_binding", orders="select (i // 3) * 200 + i % 3 as o_orderkey, i * 7919 % 15000 as o_custkey from range(6000) t(i)")
    assert "Join" not in catalogue.queries()["label_binding"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_widest_line_beside(spark):
    boxes = [(1, 0, 0.0, 0.10, 0.05, 0.12), (2, 0, 0.2, 0.10, 0.9, 0.12), (3, 0, 0.2, 0.10, 0.9, 0.12), (4, 0, 0.0, 0.50, 0.05, 0.50), (5, 0, 0.2, 0.49, 0.9, 0.51), (6, 0, 0.0, 0.14, 0.05, 0.27), (7, 0, 0.2, 0.20, 0.3, 0.26), (8, 1, 0.0, 0.10, 0.05, 0.12)]
    lines = spark.createDataFrame([(*b, b[0]) for b in boxes], "id long, page long, x0 double, y0 double, x1 double, y1 double, k long")
    got = spatial.widest_beside(lines, F.expr("x1 - x0 <= 0.06")).collect()
    assert sorted((r.id, r.widest) for r in got) == [(1, 2), (6, 7)]


def test_segment_reads_ink_only_at_gaps():
    class Ink(list):
        read = 0

        def __iter__(self):
            Ink.read += 1
            return super().__iter__()

    n = 3000
    lines = {"page": [0] * n, "x0": [0.1] * n, "y0": [i / 5000 + 0.2 * (i >= 1500) for i in range(n)], "text": ["a line of the answer"] * n}
    lines["y1"] = [y + 0.0001 for y in lines["y0"]]
    ink = {"page": Ink([0] * n), "y0": Ink([i / n for i in range(n)]), "y1": Ink([(i + 0.1) / n for i in range(n)])}
    assert [len(b) for b in papers.segment(lines, ink, set())] == [1500, 1500] and Ink.read == 3
    assert [len(b) for b in papers.segment(lines, {"page": [0], "y0": [0.3], "y1": [0.49]}, set())] == [3000]
    assert [len(b) for b in papers.segment(lines, {"page": [1], "y0": [0.3], "y1": [0.49]}, set())] == [1500, 1500]


def test_edge_headers_lists_no_pairs_of_lines(spark, tmp_path):
    # ids that are multiples of neither 3 nor 7: no line says the same as another, so every spot has to be searched
    check(spark, tmp_path, "edge_headers", orders="select k as o_orderkey, (i * i * 37 + i * 11) % 14983 as o_custkey from (select i, i * 200 * 1009 + (i * i // 7) % 40 as k from range(6000) t(i)) where k % 3 <> 0 and k % 7 <> 0")
    rows = catalogue.queries()["edge_headers"](spark, str(tmp_path))
    assert rows.count() > 0 and "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_keys_with_alike_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = {f"k{k}": ["".join(rng.choice(list("abcdefgh"[: 2 + k % 7]), rng.integers(0, 12))) for _ in range(2 + k % 9)] for k in range(60)}

    def alike(a, b):
        x, y = (Counter(t[i : i + 3] for i in range(max(len(t) - 2, 1))) for t in (a, b))
        size = lambda c: math.sqrt(sum(n * n for n in c.values()))
        return bool(a and b) and sum(n * y[g] for g, n in x.items()) / size(x) / size(y) >= 0.3

    want = {k for k, ts in texts.items() if any(alike(a, b) for i, b in enumerate(ts) for a in ts[:i])}
    rows = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "key string, ord long, plain string")
    assert 0 < len(want) < 60 and {r.key for r in similarity.keys_with_alike(rows, "key", "ord", "plain", 0.3).collect()} == want
