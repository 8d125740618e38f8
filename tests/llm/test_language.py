"""Context trees against a plain coder, and held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routeloom.llm import language_id, queries
from routeloom.llm.common import utf8

from .conftest import SF


def plain_bits(train: bytes, text: bytes, order: int, symbols: set[int]) -> float:
    """Code length with dictionaries, byte by byte."""
    counts: dict[bytes, Counter] = {}
    padded = b"\n" * order + train
    for i in range(order, len(padded)):
        for o in range(order + 1):
            counts.setdefault(padded[i - o : i], Counter())[padded[i]] += 1
    bits, padded = 0.0, b"\n" * order + text
    for i in range(order, len(padded)):
        x, excluded = padded[i], set()
        for o in range(order, -1, -1):
            own = {s: n for s, n in counts.get(padded[i - o : i], {}).items() if s not in excluded}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if x in own:
                bits -= math.log2(own[x] / total)
                break
            bits -= math.log2(len(own) / total)
            excluded |= set(own)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def test_code_lengths_are_exact():
    train = {"aa": "abra cadabra, abracadabra\nab ra", "bb": "été là-bas, été ici\nbon"}
    lang, gram, n = [], [], []
    for i, text in enumerate(train.values()):
        b = b"\n\n\n" + text.encode()
        for g, c in Counter(int.from_bytes(b[k - 3 : k + 1], "big") for k in range(3, len(b))).items():
            lang.append(i), gram.append(g), n.append(c)
    model = language_id.build(list(train), 3, 1000, *map(np.array, (lang, gram, n)))
    texts = ["abra", "", "cadé zz abr", "été\n", "x"]
    got = model.lengths(*utf8(pa.array(texts)))
    for row, text in zip(got, texts):
        for bits, own in zip(row, train.values()):
            assert math.isclose(bits, plain_bits(own.encode(), text.encode(), 3, set()), rel_tol=1e-4, abs_tol=1e-3)


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op2_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert found.count() == truth.count()


def test_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    assert model.languages == ["en"]
    rows = language_id.predict(odd_docs, model, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        known = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if known else "und") and 0 <= r.score <= 1
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language_id.predict(no_docs, model, {"doc_id": F.col("doc_id")}).count() == 0
