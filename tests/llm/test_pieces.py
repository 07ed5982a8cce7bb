import hashlib

import numpy as np
import pytest
import sentencepiece

from docspan.llm import pieces
from tests.llm.fixtures import documents, texts

AWKWARD = ["", " ", "  ", "a  b ", "x\n\n y", "漢字 é́ 🙂🙂", "a" * 500, "=-" * 300, " " * 50 + "x" + " " * 33, "▁x ▁▁", "end.\nStart"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.mark.parametrize("chunk", [17, 64, 65_536])
def test_equals_library(spark, library, chunk):
    docs = documents(spark, [*texts(), *AWKWARD], clash=True)
    want = sorted((r.doc_id, tuple(library.encode(r.text or ""))) for r in docs.collect())
    rows = pieces.encode_documents(docs, chunk=chunk).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in rows)
    assert (max(r.n_chunks for r in rows) > 1) == (chunk < 65_536)


def test_matrices_compose(library):
    e = pieces.Encoder(*pieces.load_vocabulary(pieces.default_model()))
    text = pieces.MARK + "internationalisation" * 9
    cuts = [0, 40, 90, len(text)]
    parts = [(text[max(0, a - e.longest) : a], text[a:b], text[b : b + e.longest]) for a, b in zip(cuts, cuts[1:])]
    a, b, c = (e.transfer(*p) for p in parts)
    left, right = pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c))
    assert np.array_equal(left, right)


def test_decoding_equals_library(spark, library):
    docs = documents(spark, [*texts(), *AWKWARD])
    encoded = pieces.encode_documents(docs, chunk=64).selectExpr("*", "'clash' as text")
    got = sorted((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect())
    assert got == sorted((r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect())
    import random

    r = random.Random(3)
    rows = [(i, [r.randrange(3, 32_000) if r.random() < 0.8 else r.randrange(3, 259) for _ in range(r.randint(0, 40))]) for i in range(200)] + [(900, [1, 15, 2, 0, 99]), (901, None), (902, [])]
    got = dict(pieces.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect())
    assert all(got[i] == (library.decode(ids) if ids else "") for i, ids in rows)


def test_a_very_long_text_and_rows_without_doc_id(spark, library):
    long = "word and more, " * 40_000
    rows = [(None, long), (None, long), (None, "short"), (4, None)]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_pieces) for r in got) == sorted((i or 0, len(library.encode(t or ""))) for i, t in rows)
    assert max(r.n_chunks for r in got) > 5 and all(r.round_trip for r in got)


def test_short_and_long_stretches_are_the_same_path(library):
    import random

    e, r = pieces.Encoder(*pieces.load_vocabulary(pieces.default_model())), random.Random(4)
    for _ in range(400):
        word = pieces.MARK + "".join(r.choices("aeioustnrlhd.,'é漢0", k=r.randint(1, 40)))
        assert e.merged(word) == e.walk(word)


def test_empty_table(spark):
    assert pieces.encode_documents(documents(spark, [])).count() == 0
    assert pieces.decode_documents(pieces.encode_documents(documents(spark, []))).count() == 0
