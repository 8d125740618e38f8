import numpy as np
import pandas as pd
import pytest

from routeloom.operators import documents, retrieval, term_search


@pytest.mark.parametrize("least", [False, True])
def test_bounded_search_equals_all_products(least, monkeypatch):
    """Copies, ties, empty texts, words given often, questions of more terms than share a number; most pairs are only bounded."""
    rng = np.random.default_rng(5)
    dims, n = 300, 9_000
    weights = rng.uniform(0, 4, dims)
    weights[:3] = 0
    texts = [rng.integers(0, dims, rng.integers(0, 40)) for _ in range(n)]
    texts[500:900] = [texts[3]] * 400
    texts[7_000] = np.full(900, 8)
    asked = [texts[i] for i in (3, 600, 7_000)] + [rng.integers(0, dims, m) for m in (0, 1, 5, 30, 99, 101, 400)] * 6 + [np.zeros(4, int)]
    cells = lambda rows: [r.astype("<u2").tobytes() for r in rows]
    corpus = pd.DataFrame({"id": rng.permutation(n), "v": cells(texts)})
    queries = pd.DataFrame({"qid": np.arange(len(asked)), "v": cells(asked), "least": np.nan})
    unit = lambda side: retrieval._normed(documents.unpacked(weights)(side["v"]))
    scores = np.rint(unit(queries) @ unit(corpus).T * retrieval.SCALE)
    order = [np.lexsort((corpus["id"], -row))[:3] for row in scores]
    if least:  # a bound that the third reaches just so
        queries["least"] = [row[o[-1]] / retrieval.SCALE for row, o in zip(scores, order)]
    scored = []
    pairs = term_search._pairs
    monkeypatch.setattr(term_search, "_pairs", lambda q, r, j, c: scored.append(len(r)) or pairs(q, r, j, c))
    got = term_search.best(queries, corpus, weights, 3)
    want = {(q, corpus["id"][i], row[i]) for q, (row, o) in enumerate(zip(scores, order)) for i in o}
    assert {(r.qid, r.id, round(r.score * retrieval.SCALE)) for r in got.itertuples()} >= want
    assert len(got) == 3 * len(asked)
    assert 0 < sum(scored) < scores.size / 10


def test_blocks_and_first_bound_give_all_products(spark):
    """Ids come twice; the part of the corpus worked out first only spares pairs."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    text = lambda m: " ".join(rng.choice(words, m))
    corpus = spark.createDataFrame([(f"d{i % 550}", text(20)) for i in range(600)], "id string, text string").cache()
    asked = spark.createDataFrame([(f"q{i % 28}", text(6)) for i in range(30)], "qid string, text string").cache()
    weights = documents.fit_vectorizer(corpus)
    packed = lambda df: documents.vectorize(df, weights, packed=True).cache()
    found = lambda df: sorted((r.qid, r["rank"], r.score) for r in df.collect())
    want = found(retrieval.top_k(packed(asked), packed(corpus), unpack=documents.unpacked(weights)))
    assert found(term_search.top_k(packed(asked), packed(corpus), weights, pilot=100)) == want
    assert found(term_search.top_k(packed(asked), packed(corpus), weights)) == want


def test_packed_slots_and_weights_are_those_of_the_jvm(spark):
    points = [*range(1, 0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0), 0x3A3, 0x416, 0x4E00, 0x1F600]
    texts = [chr(c).join(("a", "B ", " ", "x")) for c in points] + [None, "", " ", "Été, ÉTÉ_2 “x”"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    both = df.select(documents.packed_slots("text", 1024).alias("embedding"), documents.term_slots("text", 1024).alias("slots"), "text").cache()
    for r in both.collect():
        assert np.frombuffer(r.embedding, "<u2").tolist() == r.slots
    assert np.array_equal(documents.fit_packed(both), documents.fit_vectorizer(both))
