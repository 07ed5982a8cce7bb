import random

import numpy as np
import pytest

from docspan.operators import alignment, folds, labels, marking, spatial


@pytest.mark.parametrize(
    ("text", "tokens", "rest"),
    [
        ("1. Define x", ["1"], "Define x"),
        ("(a) State", ["a"], "State"),
        ("a) State", ["a"], "State"),
        ("Q3 (4 Marks)", ["3"], "(4 Marks)"),
        ("Question 4. Explain", ["4"], "Explain"),
        ("2(b) Explain", ["2", "b"], "Explain"),
        ("(ii) Draw", ["ii"], "Draw"),
        ("2 (i) (a) Why", ["2", "i", "a"], "Why"),
        ("(II.) x", ["II"], "x"),
        ("( a ) State", ["a"], "State"),
        ("1 . Define", ["1"], "Define"),
        ("13 [4 marks]", ["13"], "[4 marks]"),
        ("2 (íi) The sílt", ["2", "ii"], "The sílt"),
        ("2 a) Why", ["2", "a"], "Why"),
        ("11  (a)   Draw", ["11", "a"], "Draw"),
    ],
)
def test_labels(text, tokens, rest):
    found = labels.parse_label(text)
    assert found is not None and list(found.tokens) == tokens and found.remainder == rest


@pytest.mark.parametrize("text", ["Quote the formula", "The answer", "12 apples", "", "A4 paper", "Questions like this"])
def test_no_label(text):
    assert labels.parse_label(text) is None


def test_section_letters():
    assert labels.parse_label("T1 Prove it") is None
    found = labels.parse_label("T1 Prove it", frozenset("T"))
    assert (found.tokens, found.section, found.remainder, found.style) == (("1",), "T", "Prove it", "numeric")
    assert labels.parse_label("Q2 (5 Marks)", frozenset("Q")).section is None


def test_deaccent_keeps_length():
    assert labels.deaccent("é½漢x") == "e1漢x"


def best_value(scores, goes_on, agrees, share, i=0, j=0, state="free"):
    """The value of the best path, by trying every move."""
    n, m, low = len(scores), len(scores[0]), float("-inf")
    if i == n and j == m:
        return 0.0
    ways = []
    go = lambda value, *to: ways.append(value + best_value(scores, goes_on, agrees, share, *to))
    if i < n and j < m and scores[i][j] > low:
        go(scores[i][j], i + 1, j + 1, "match")
    if state in ("match", "on") and j < m and scores[i - 1][j] > low:
        go(alignment.CONTINUE + 0.5 * goes_on[j - 1] + (agrees[j] == i - 1) + scores[i - 1][j], i, j + 1, "on")
    if state in ("match", "share") and i < n and scores[i][j - 1] > low and share(i, j - 1) is not None:
        go(alignment.SHARE + scores[i][j - 1] + share(i, j - 1), i + 1, j, "share")
    if i < n:
        go(alignment.SKIP_QUESTION, i + 1, j, "free")
    if j < m:
        go(alignment.SKIP_BLOCK, i, j + 1, "free")
    return max(ways)


def value_of(pairs, scores, goes_on, agrees, share):
    """The value of the path that gives the pairs."""
    n, m = len(scores), len(scores[0])
    value = alignment.SKIP_QUESTION * (n - len({i for i, _ in pairs})) + alignment.SKIP_BLOCK * (m - len({j for _, j in pairs}))
    before = None
    for i, j in pairs:
        value += scores[i][j]
        if before and before[0] == i:
            value += alignment.CONTINUE + 0.5 * goes_on[j - 1] + (agrees[j] == i)
        elif before and before[1] == j:
            value += alignment.SHARE + share(i, j)
        before = i, j
    return value


def test_alignment_is_best_monotone_path():
    r = random.Random(3)
    shared = went_on = 0
    for _ in range(150):
        n, m = r.randint(1, 4), r.randint(1, 4)
        scores = [[r.choice([float("-inf"), r.uniform(-0.3, 0.9)]) for _ in range(m)] for _ in range(n)]
        goes_on, agrees = [r.random() < 0.3 for _ in range(m)], [r.choice([None, r.randrange(n)]) for _ in range(m)]
        table = {(i, j): r.choice([None, 0.55, -0.9]) for i in range(n) for j in range(m)}
        share = lambda i, j: table[i, j]  # noqa: B023, E731
        pairs = alignment.align(scores, goes_on, agrees, share)
        assert pairs == sorted(pairs)
        assert value_of(pairs, scores, goes_on, agrees, share) == pytest.approx(best_value(scores, goes_on, agrees, share))
        shared += any(a[1] == b[1] for a, b in zip(pairs, pairs[1:]))
        went_on += any(a[0] == b[0] for a, b in zip(pairs, pairs[1:]))
    assert shared > 3 and went_on > 3


def test_relatives_and_parts():
    s = alignment.Sheet(np.zeros((5, 1)), paths=[("1",), ("2",), ("11", "a"), ("11", "b"), ("11",)])
    assert s.related(0, 1) and not s.parts(0, 1) and s.related(2, 3) and s.parts(2, 3) and s.parts(2, 4) and not s.related(0, 2)


def test_decisive_questions_keep_their_blocks():
    sim = np.array([[0.9, 0.2], [0.65, 0.2], [0.0, 0.2]])
    assert alignment.decided(alignment.pair_scores(alignment.Sheet(sim))) == [0, None]
    parts = alignment.Sheet(sim, paths=[("3", "a"), ("3", "b"), ("4",)])
    assert alignment.decided(alignment.pair_scores(parts)) == [None, None]


def test_passes_of_an_assignment():
    sim = np.array([[0.9, 0.0, 0.0, 0.0, 0.6], [0.0, 0.8, 0.1, 0.0, 0.0], [0.0, 0.0, 0.0, 0.7, 0.0]])
    sheet = alignment.Sheet(sim, chars=[50, 50, 8, 50, 50], runs_on=[False, False, True, False, False], labels=[(2, 0), (2, 3)])
    got = alignment.assign(sheet)
    assert (2, 0, "label") in got and (1, 1, "decided") in got and (1, 2, "decided") in got or (1, 2, "continuation") in got
    assert [j for _, j, _ in got] == sorted(j for _, j, _ in got)


def test_agreement_looks_past_fragments():
    sim = np.array([[0.9, 0.0, 0.9, 0.1], [0.0, 0.0, 0.0, 0.9]])
    sheet = alignment.Sheet(sim, chars=[40, 6, 40, 40])
    assert alignment.agreements(sheet, alignment.pair_scores(sheet)) == [None, None, 0, None]


def test_classifier_roles():
    lines = ["SECTION A", "1. Define the cell.", "It has parts.", "[3]", "Each question carries 2 marks.", "2", "Read the source below and answer.", "Some printed words", "(a) Explain them.", "Page 3 of 4", ""]
    roles = alignment.classify_lines(lines)
    assert roles[:5] == ["section_header", "question_start", "question_continuation", "marks", "instruction"]
    assert roles[7] == "material" and roles[8] == "question_start" and roles[9:] == ["furniture", "furniture"]


def test_admission_and_longest_run(spark):
    rows = spark.createDataFrame([(1, i, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 3, 20])], "k long, id long, ts string").selectExpr("k", "id", "cast(ts as timestamp_ntz) ts")
    got = {r.id: r.allowed for r in folds.admit(rows, "k", "id", "ts", 2, 600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}
    run = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate([3, 1, 2, 2, 5, 4])], "k long, o long, v double")
    assert folds.longest_run(run, "k", "o", "v").first().longest == 4


def test_overlap_pairs_equal_brute_force(spark):
    random.seed(5)
    rows = [(i, i % 3, x := random.random() * 0.6, y := random.random() * 0.8, x + 0.2, y + random.random() * 0.19 + 0.001) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, page long, x0 double, y0 double, x1 double, y1 double")
    from docspan.functions import geometry as G

    got = spatial.overlap_pairs(spatial.prefixed(df, "a"), spatial.prefixed(df, "b"), (G.intersection(G.box("a_"), G.box("b_")) > 0)).select("a_id", "b_id").collect()
    want = {(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_greedy_recall_and_merge(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.1), (2, 1, 0.0, 0.02, 0.5, 0.12)], "id long, page long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(9, 1, 0.0, 0.0, 0.5, 0.1)], t.schema)
    assert spatial.greedy_recall(t, p, 0.3).first().n_found == 1
    merged = spatial.merge_overlapping(t).collect()
    assert len(merged) == 1 and merged[0].n == 2 and merged[0].y1 == pytest.approx(0.12)


def test_marking_assembly(spark):
    checks = spark.createDataFrame(
        [("s", "q", 2.0, True, None, False, ["l1"], ["l1"]), ("s", "q", 1.0, None, None, True, [], ["l1"]), ("s", "q", 3.0, False, "wrong", False, [], ["l1"]), ("s", "r", 1.0, True, None, False, ["zz"], ["l1"])],
        "sub_id string, qid string, marks double, met boolean, error string, unverifiable boolean, cited array<string>, known array<string>",
    )
    got = {r.qid: (r.awarded, r.available, r.needs_review) for r in marking.assemble_checks(checks).collect()}
    assert got == {"q": (3.0, 6.0, False), "r": (0.0, 1.0, True)}
    points = spark.createDataFrame([("s", "q", 2.0, 9.0, False, ["l1"], ["l1"]), ("s", "q", 1.0, 1.0, True, [], ["l1"]), ("s", "r", 2.0, 2.0, True, ["bad"], ["l1"])], "sub_id string, qid string, criterion double, given double, satisfied boolean, cited array<string>, known array<string>")
    got = {r.qid: (r.awarded, r.judged) for r in marking.assemble_points(points).collect()}
    assert got == {"q": (2.0, True), "r": (0.0, False)}


def test_question_extraction(spark):
    from docspan.operators import papers

    lines = [("SECTION A", 0.1), ("Each question carries 3 marks.", 0.1), ("1. Define a cell. [2]", 0.1), ("Read the source below and answer.", 0.1), ("The cell is small.", 0.1), ("2. Answer the following:", 0.1), ("(a) Use the source to explain.", 0.15), ("It is long.", 0.15), ("(b) Draw it.", 0.15), ("[4]", 0.9), ("1. again", 0.1)]
    got = {q["qid"]: q for q in papers.extract_questions([{"text": t, "x0": x} for t, x in lines])}
    assert list(got) == ["A/1", "A/2", "A/2/a", "A/2/b"]
    assert got["A/1"]["marks"] == 2 and got["A/1"]["text"].endswith("again") and got["A/2"]["is_stem"]
    assert got["A/2/a"]["text"] == "Use the source to explain. It is long." and got["A/2/a"]["marks"] == 3 and got["A/2/a"]["material"] == 1 and got["A/2/b"]["marks"] == 4
    df = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(lines)], "paper_id long, ord long, text string, x0 double")
    assert papers.question_papers(df).count() == 4


def test_segmentation(spark):
    from docspan.operators import papers

    rows = [("s", 0, 0, 0.1, 0.10, "1. the first answer"), ("s", 1, 0, 0.1, 0.13, "goes on here"), ("s", 2, 0, 0.1, 0.30, "another after a gap"), ("s", 3, 0, 0.1, 0.50, "bridged by a drawing cont."), ("s", 4, 1, 0.1, 0.05, "on the next page"), ("s", 5, 1, 0.1, 0.08, "2. the second")]
    lines = spark.createDataFrame([(*r[:5], r[4] + 0.02, r[5]) for r in rows], "sub_id string, ord long, page long, x0 double, y0 double, y1 double, text string")
    ink = spark.createDataFrame([("s", 0, 0.33, 0.49)], "sub_id string, page long, y0 double, y1 double")
    got = papers.answer_blocks(lines, ink, [["1"], ["2"]]).orderBy("ord").collect()
    assert [(r.block_id, r.n_lines, r.pages) for r in got] == [("blk:000", 2, [0]), ("blk:001", 3, [0, 1]), ("blk:002", 1, [1])]


def test_raster(spark):
    import numpy as np

    from docspan.operators import raster

    grey = np.full((120, 200), 250, np.uint8)
    grey[20:30, 20:120] = 30
    grey[60:64, 60:64] = 20
    grey[100, 5] = 0
    regions = raster.find_regions(grey)
    assert [r["kind"] for r in regions][:2] == ["writing", "writing"] and regions[0]["pixel_count"] == 1000 and regions[0]["has_strike"]
    assert abs(regions[0]["x0"] - 0.1) < 1e-9 and abs(regions[0]["y1"] - 0.25) < 1e-9
    rng = np.random.default_rng(1)
    mask = rng.random((40, 60)) < 0.4
    labels = raster.components(mask)
    seen = np.zeros_like(mask)
    count = 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 60 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    assert labels[a, b] == labels[y, x]
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert labels.max() == count
    tilted = np.zeros((200, 300), bool)
    for k in range(20, 180, 20):
        for x in range(300):
            tilted[int(k + x * np.tan(np.radians(2))) % 200, x] = True
    assert abs(raster.skew_angle(tilted) - 2) <= 0.25
    pages = spark.createDataFrame([("k", 0, 200, 120, bytearray(grey.tobytes()))], "page_key string, page int, width int, height int, pixels binary")
    assert raster.ink_regions(pages).count() == len(regions)


def test_review_scalars(spark):
    from pyspark.sql import functions as F

    from docspan.functions import review as R

    row = spark.range(1).select(
        R.requested_count(F.lit("Give any two reasons")).alias("a"), R.requested_count(F.lit("State 3 marks")).alias("b"), R.requested_count(F.lit("Find two grams")).alias("c"), R.ordinal(F.lit(3)).alias("d"), R.ordinal(F.lit(11)).alias("e"),
        R.as_statement(F.lit("Does the answer give the value 15 m/s?")).alias("f"), R.as_statement(F.lit("Units present?")).alias("g"), R.wait_seconds(F.lit("try again in 1m2.5s"), F.lit(1)).alias("h"), R.wait_seconds(F.lit("try again in 9m2s"), F.lit(1)).alias("i"),
        R.wait_seconds(F.lit("error 429"), F.lit(3)).alias("j"), R.parse_mark(F.lit(" 2.5 "), F.lit(5.0)).alias("k"), R.parse_mark(F.lit("7"), F.lit(5.0)).alias("l"), R.parse_mark(F.lit(""), F.lit(5.0)).alias("m"), R.score_label(F.lit(3.5), F.lit(5.0)).alias("n"),
        R.preview(F.lit("a  b\n" + "x" * 80)).alias("o"), R.caption(F.lit("reading"), F.lit(2), F.lit(5)).alias("p"), R.expected_label(F.lit("Q 4."), F.lit(4), F.lit(5)).alias("q"), R.multiset_recall(F.lit("a a b"), F.lit("A, c b")).alias("r"),
        R.contrast_ratio(F.lit("#000000"), F.lit("#ffffff")).alias("s"), R.score_tone(F.lit(0.0), F.lit(4.0), F.lit(True)).alias("t"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (2, None, None, "third", "11th")
    assert (row.f, row.g, row.h, row.i, row.j) == ("The answer gives the value 15 m/s", "Units present", 62.5, None, 8.0)
    assert tuple(row.k) == (2.5, True) and tuple(row.l) == (None, False) and tuple(row.m) == (None, True) and row.n == "3.5 / 5"
    assert row.o.endswith("…") and len(row.o) == 61 and row.p == "reading · page 2 of 5" and row.q == "Q 5." and abs(row.r - 2 / 3) < 1e-9 and abs(row.s - 21) < 1e-6 and row.t == "zero"


def test_nearest_vectors_in_tiles(spark, monkeypatch):
    from docspan.operators import similarity

    monkeypatch.setattr(similarity, "VECTORS", 7)
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(90)]
    got = {(x.vec_id, x.k): x.other for x in similarity.nearest(spark.createDataFrame(rows, "vec_id long, v array<double>, g int"), "vec_id", "g", "v", 3).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    for i, _, g in rows:
        others = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j, _, h in rows if h == g and j != i)
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in others[:3]]
