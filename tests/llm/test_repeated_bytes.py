"""Repeated strings against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from routeloom.llm import queries, repeated_bytes

from .conftest import SF


def brute(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[s : s + length]) for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[hash(b[s : s + length])] > 1:
                gone[s] += 1
                gone[s + length] -= 1 if s + length <= len(b) else 0
        mask = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[False], mask]).astype(int)) == 1).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def made_up(seed, docs=60):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdeé \n") for _ in range(n))

    passages = [noise(n) for n in (300, 399, 400, 401, 450, 700, 1500)] + ["ab" * 300, "x" * 500]
    rows = []
    for i in range(docs):
        text = "".join(noise(rng.randrange(200)) + rng.choice(passages)[rng.randrange(60) :] for _ in range(rng.randrange(5)))
        rows.append((i, text))
    return rows + [(100, rows[3][1]), (101, "y" * 399), (102, "z" * 401), (103, "z" * 3 + "w"), (104, None), (None, rows[5][1])]


@pytest.mark.parametrize("seed,part", [(1, 2000), (2, 3)])
def test_passages(spark, monkeypatch, seed, part):
    monkeypatch.setattr(repeated_bytes, "PART", part)
    rows = made_up(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(repeated_bytes.remaining(df)) == brute(rows)


def test_slices_do_not_matter(monkeypatch):
    data = np.frombuffer("".join(t or "" for _, t in made_up(3)).encode(), np.uint8)
    sizes = [len((t or "").encode()) for _, t in made_up(3)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    want = repeated_bytes.anchors(data, offsets, 400)
    monkeypatch.setattr(repeated_bytes, "_SLICE", 500)
    for a, b in zip(repeated_bytes.anchors(data, offsets, 400), want):
        assert (a == b).all()


def test_factors():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 20, 60).astype(np.uint64)
    position = rng.permutation(60)
    earlier, later = repeated_bytes.factors(np.argsort(value, kind="stable"), value, position)
    for i in range(60):
        same = position[value == value[i]]
        assert earlier[i] == (same < position[i]).any() and later[i] == (same > position[i]).any()


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.QUERIES["op8_repeated_bytes"](spark, SF)) == brute(docs)


def test_texts_are_returned(spark):
    rows = [(1, "q" + "ab c" * 120), (2, "ab c" * 120 + "r"), (3, "short")]
    out = {r.doc_id: r for r in repeated_bytes.remaining(spark.createDataFrame(rows, "doc_id bigint, text string"), texts=True).collect()}
    assert out[1].spans == [[1, 481]] and bytes(out[1].kept) == b"q"
    assert out[3].spans == [] and out[3].kept is None


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(repeated_bytes.remaining(odd_docs)) == brute(rows)
    assert repeated_bytes.remaining(no_docs).count() == 0
