"""Token files and packing against whole-text encoding by the library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routeloom.llm import byte_tokens, packing, queries, token_files
from routeloom.llm.byte_tokens import encoder

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.BYTES)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '\n\t.,s1é  \x1c\x85中Ͱ")), max_size=40))
def test_remembered_words_give_the_library_ids(text):
    e = encoder(queries.BYTES)
    assert e.encode(text) == e.whole(text)


PIECES = ["a", "Bc", "é", "É", "ɏ", "ɐ", "中", "…", "²", "1", " ", " ", "\n", "\n\n", "\t", "\r\n", ".", "!!", "?", "'", "'s", "-", "\u0301", "\u200b", "ª", "×", " b.\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_chunks_end_where_words_end(text):
    e = encoder(queries.BYTES)
    assert e.encode(text) == e.whole(text)


def test_a_word_is_remembered_whatever_stands_behind_it():
    e = byte_tokens.Encoder(queries.BYTES)
    made, tokenize = [], e.tokenize
    e.tokenize = lambda x: made.append(x) or tokenize(x)
    text = "ab ab ab. ab, ab!! ab; ab\n\nab ab: ab.\nab, ab ab. ab?"
    assert e.encode(text) == e.whole(text)
    assert made.count(e.space + "ab") == 2  # words that come once are not remembered


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_code_round_trip(ranks):
    control, data = token_files.pack(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks


def expected_files(rows, library):
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library(text)
        out.setdefault(doc_id, []).append((start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_files_match_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = expected_files([tuple(r) for r in docs.collect()], library)
    got = {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in queries.QUERIES["op1_token_files"](spark, SF).collect()}
    assert got == want


def test_files_of_odd_rows(odd_docs, no_docs, library):
    want = expected_files([(r.doc_id, r.text) for r in odd_docs.collect()], library)
    got = defaultdict(list)
    for r in sorted(token_files.token_files(odd_docs, queries.BYTES).collect(), key=lambda r: r.start):
        got[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    assert got == want
    assert token_files.token_files(no_docs, queries.BYTES).count() == 0


def check_packing(rows, docs, library, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        if own[0]["class"] is not None:
            assert {r["class"] for r in own} == {len(own)}
    wanted = defaultdict(list)
    for doc_id, text in docs:
        wanted[doc_id].append(library(text))
    assert set(by_doc) == set(wanted)
    for doc_id, texts in wanted.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        expect = []
        for ids in texts:
            if len(texts) == 1:
                assert pieces[0][0] == 0 and sum(p[1] for p in pieces) == len(ids)
                assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            expect += [(p[0], p[1], crc(ids[p[0] : p[0] + p[1]]), len(ids)) for p in (pieces[:: len(texts)])]
        assert pieces == sorted(expect)
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_packing_matches_the_library(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    full = check_packing(queries.QUERIES["op10_packing"](spark, SF).collect(), docs, library, 1024)
    assert full > 0.97


def test_packing_of_odd_rows(odd_docs, no_docs, library):
    check_packing(packing.pack(odd_docs, queries.BYTES).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], library, 1024)
    assert packing.pack(no_docs, queries.BYTES).count() == 0
    with_ids = packing.pack(odd_docs, queries.BYTES, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)
