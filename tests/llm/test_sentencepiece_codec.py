import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OURS = sc.PieceCodec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abt hero.,!▁é你😀\n\t<>/s0'\x00　ﬁ²")), max_size=60))
def test_encoding_and_decoding_equal_the_library(text):
    ids = LIBRARY.encode(text)
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(list(OURS.ids)), max_size=8))
def test_concatenated_pieces_equal_the_library(pieces):
    text = "".join(pieces)
    assert OURS.encode(text) == LIBRARY.encode(text)


def test_merging_agrees_with_backtracking():
    for part in ("▁thereinafter", "aaaaaaaaaaaa", "▁▁▁▁▁▁▁", "........", "ßßéé"):
        assert OURS.pieces(part) == OURS.merged(part)


def expected(text):
    ids = LIBRARY.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "   ", "same text", "same text", "x" * 30_000, "word, " * 9_000, "a▁b  c\n\n", "<s>[INST]</s>"]
    return [(i, t, i % 2, "z") for i, t in enumerate(texts)] + [(None, "no id", 0, "z")]


def test_documents_round_trip(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in sc.round_trip_digests(docs, MODEL).collect()}
    assert got == {r[0]: expected(r[1]) for r in rows}
    coded = sc.encode_documents(docs, MODEL)
    assert {r[0]: r[1] for r in coded.collect()} == {r[0]: LIBRARY.encode(r[1] or "") for r in rows}
    back = sc.decode_documents(coded, MODEL)
    assert {r[0]: r[1] for r in back.collect()} == {r[0]: LIBRARY.decode(LIBRARY.encode(r[1] or "")) for r in rows}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sc.round_trip_digests(docs, MODEL).collect() == []
