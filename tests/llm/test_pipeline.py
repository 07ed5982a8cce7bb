import pytest
import sentencepiece

import corpus_pipeline
from docspan.llm import pieces, surrogates, toxicity
from tests.llm.fixtures import documents, texts
from tests.llm.test_jaccard import brute


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    kept = {i: t for i, t in rows.items() if not scores[i]}
    kept = {i: kept[i] for i, (_, c) in brute(list(kept.items()), 5, 4, 5).items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    index = [shingles(t) for t in items]
    kept = {i: t for i, t in kept.items() if not any(len(s & own) >= 0.8 * len(s) for own in [shingles(t)] for s in index)}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    import hashlib

    key = hashlib.blake2b(surrogates.TEST_KEY.encode(), digest_size=32).digest()
    want = {i: library.encode(surrogates.replace_entities(t, key)[0]) for i, t in kept.items()}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < len(rows)


CLASH = ("pii", "found_id", "drop_id", "v", "row_hash", "is_hot", "hash", "head", "n", "class_id", "doc", "rid", "y", "label_id", "score", "words", "row", "item_id")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_all_columns_and_awkward_rows(spark, sf_dir, stage):
    docs = documents(spark, [*texts(), None, "Mr. John Smith, a.b@example.com"])
    for c in CLASH:
        docs = docs.selectExpr("*", f"'clash' as {c}")
    out = stage[1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == "clash" for r in rows for c in CLASH) and rows
    assert sum(not (r.text or "").strip() for r in rows) == sum(not (r.text or "").strip() for r in docs.collect())
    assert stage[1](spark, docs.limit(0), sf_dir).count() == 0


def test_one_row_of_each_group_stays(spark, sf_dir):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base), (5, base), (5, base + " x"), (3, base + " y"), (None, base), (None, "lone words here that are enough"), (None, "lone words here that are enough"), (8, None), (8, None), (9, "other text with some more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [(0, "lone words here that are enough"), (3, base + " y"), (8, ""), (8, ""), (9, "other text with some more words")]
    twice = spark.createDataFrame([(4, base), (4, base), (4, base)], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, twice, sf_dir).count() == 1
