"""Strings of added tokens in texts, against the library as it comes."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routeloom.llm import packing, queries, token_files
from routeloom.llm.byte_tokens import encoder

from .test_tokens import check_packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "plain words", "<|endoftext| >", " <|endoftext|>  it's\n"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.BYTES)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_the_call_of_the_contract(library):
    assert library(TEXTS[0]) == [64, 220, 50256, 275]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "a", "\n", "é", "1", "\u4e2d"]), max_size=12).map("".join))
def test_ids_are_the_library_s(library, text):
    e = encoder(queries.BYTES)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == library(text)


def test_files_and_packing(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    start = 0
    rows = sorted(token_files.token_files(docs, queries.BYTES).collect(), key=lambda r: r.doc_id)
    for r, text in zip(rows, TEXTS, strict=True):
        ids = library(text) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    check_packing(packing.pack(docs, queries.BYTES).collect(), list(enumerate(TEXTS)), lambda t: library(t) + [0], 1024)
