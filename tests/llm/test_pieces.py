"""The piece codec against the library."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import piece_codec, queries

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab theinr \n\t.,'▁é中\U0001f600\0()0123_-​")), max_size=40) | st.text(max_size=20))
def test_same_ids_and_text_as_the_library(text):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    c = piece_codec.codec(queries.PIECES)
    import numpy as np

    ids = np.frombuffer(c.encode(text), c.dtype).tolist()
    assert ids == model.encode(text) + [2]
    assert c.decode(ids) == model.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(3, 400) | st.integers(0, 31999), max_size=12))
def test_decoding_of_any_ids(ids):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    if 0 not in ids:
        assert piece_codec.codec(queries.PIECES).decode(ids) == model.decode(ids)


def test_documents(spark, library):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op4_piece_codec"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(odd_docs, no_docs, library):
    want = sorted(((r.doc_id, library.encode(r.text or "") + [2]) for r in odd_docs.collect()), key=str)
    got = piece_codec.encode_decode(odd_docs, queries.PIECES).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert all(r.decoded == library.decode(r.ids) for r in got)
    assert piece_codec.digests(no_docs, queries.PIECES).count() == 0
