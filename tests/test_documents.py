import random
import re

import numpy as np
import pandas as pd

from routeloom.operators import documents, retrieval


def clean(text, skip=250):
    """The cleaning rules, line by line."""
    lines = text.splitlines()
    find = lambda test, default: next((i for i, x in enumerate(lines) if test(x.lower())), default)
    lines = lines[find(lambda x: "abstract" in x, 0):]
    toc, body = find(lambda x: "table of contents" in x, None), find(lambda x: re.match(r"[ \t]*1\.[ \t]+introduction", x), None)
    if toc is not None and body is not None and toc < body:
        lines = lines[:toc] + lines[body:]
    for i in range(skip, len(lines)):
        if any(h in lines[i].lower() for h in documents.BACK_MATTER):
            lines = lines[:i]
            break
    return "\n".join(x.strip() for x in lines if x.strip())


def samples():
    rng = random.Random(11)
    pool = ["", "  ", "Abstract", "the ABSTRACT of it", "Table of Contents", "  1.  Introduction ... 3", "1. Introduction", "2. Body",
            "x 1. Introduction", "9. Normative References", "Intellectual Property", " padded　", "word " * 5, "t\tab", "z"]
    breaks = ["\n", "\r\n", "\n\n", "\x0c", " ", "\r", "\x85"]
    out = ["", "one line", "\n\n", "Abstract", "a" * 50]
    for _ in range(300):
        out.append("".join(rng.choice(pool) + rng.choice(breaks) for _ in range(rng.randint(1, 25))) + rng.choice(["", "end"]))
    return out


def test_cleaning_equals_the_line_rules(spark):
    texts = samples()
    for skip in (0, 1, 4, 250):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        for r in documents.clean_documents(df, skip_lines=skip).collect():
            assert r.text == clean(texts[r.i], skip), (skip, texts[r.i])


def test_strict_contents(spark):
    text = "Abstract\nTable of Contents\n1. Introduction ... 2\n2. Rest\n1. Introduction\nbody"
    df = spark.createDataFrame([(text,), ("Table of Contents\nnone",)], "text string")
    got = [r.text for r in documents.clean_documents(df, strict_toc=True).collect()]
    assert got == ["Abstract\n1. Introduction\nbody", "Table of Contents\nnone"]


def test_names_and_labels(spark):
    df = spark.createDataFrame([("rfc4271.txt",), ("a.txt.txt",), ("notes",)], "source string")
    names = df.withColumn("source", documents.clean_name("source"))
    assert [(r[0], r[1]) for r in names.withColumn("label", documents.document_label("source")).collect()] == [
        ("rfc4271_clean.txt", "RFC 4271"), ("a_clean.txt_clean.txt", "Unknown RFC"), ("notes", "Unknown RFC"),
    ]


def test_chunk_contract():
    rng = random.Random(2)
    for _ in range(200):
        words = [f"{i:03d}" + "w" * rng.choice([1, 3, 9, 30, 90]) for i in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\n\n"]) for w in words).strip()
        chunks = documents.split_text(text, 200, 50)
        assert all(0 < len(c) <= 200 for c in chunks)
        at = 0
        for c in chunks:  # every chunk lies in the text, in order, and nothing but blanks is between them
            where = text.find(c)
            assert where >= at - 50
            assert not text[at:where].strip()
            at = where + len(c)
        assert not text[at:].strip()


def test_chunks_prefer_coarse_borders():
    assert documents.split_text("a b\n\nc d", 5, 0) == ["a b", "c d"]
    assert documents.split_text("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert documents.split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert documents.split_text("short", 800, 100) == ["short"]


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a", "x " * 500), ("b", ""), ("c", None)], "source string, text string")
    rows = documents.chunk_documents(df).collect()
    assert {r.source for r in rows} == {"a"} and [r.chunk_no for r in rows] == list(range(len(rows)))


def brute(queries, corpus, k, same):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, c = np.array([v for _, v in queries]), np.array([v for _, v in corpus])
    scores = np.round(unit(q) @ unit(c).T, 6)
    out = {}
    for i, (qid, _) in enumerate(queries):
        ranked = sorted((-scores[i, j], cid) for j, (cid, _) in enumerate(corpus) if not (same and cid == qid))
        out[qid] = [cid for _, cid in ranked[:k]]
    return out


def test_top_k_over_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(180, 6)))]
    vectors += [(i, vectors[7][1]) for i in range(180, 260)]  # a third of the rows are copies of one vector
    q = spark.createDataFrame(vectors, "qid bigint, embedding array<double>")
    c = spark.createDataFrame(vectors, "id bigint, embedding array<double>")
    for same in (True, False):
        got = {}
        for r in retrieval.top_k(q, c, k=4, exclude_same=same, query_block=40, corpus_block=30).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == brute(vectors, vectors, 4, same)


def test_top_k_with_few_or_no_rows(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, embedding array<double>")
    c = spark.createDataFrame([(5, [1.0, 1.0]), (6, [0.0, 0.0]), (7, None)], "id bigint, embedding array<double>")
    rows = retrieval.top_k(q, c, k=3).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in rows] == [(5, 0.707107), (6, 0.0)]
    assert retrieval.top_k(q, c.limit(0), k=3).count() == 0


def test_vectors_find_their_own_text(spark):
    texts = ["route origin validation", "community attributes of paths", "graceful restart of sessions", "origin validation of a route"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    model = documents.fit_vectorizer(df, dims=512)
    vectors = documents.vectorize(df, model)
    for r in vectors.collect():
        assert abs(np.linalg.norm(r.embedding) - 1) < 1e-5
    found = retrieval.top_k(vectors.withColumnRenamed("id", "qid"), vectors, k=2, exclude_same=True)
    best = {r.qid: r.id for r in found.where("rank = 1").collect()}
    assert best[0] == 3 and best[3] == 0
    shaped = retrieval.shaped_documents(found, df.selectExpr("id", "text", "'rfc1_clean.txt' AS source"), max_docs=1)
    assert {(r.qid, r.source) for r in shaped.collect()} == {(i, "RFC 1") for i in range(4)}


def test_packed_vectors_are_the_same_and_small(spark):
    texts = ["route origin validation of a route", "", None, "…", "community " * 300 + "path", "ünïcode wörds 12 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    weights = documents.fit_vectorizer(df, dims=512)
    plain = documents.vectorize(df, weights).orderBy("id").toPandas()["embedding"]
    cells = documents.vectorize(df, weights, packed=True).orderBy("id").toPandas()["embedding"]
    unit = retrieval._normed(documents.unpacked(weights)(cells))
    assert np.allclose(unit, np.stack(plain), atol=1e-12)
    assert max(map(len, cells)) <= 2 * 301  # two bytes a term, not eight a dimension
    rows = lambda packed, **how: {
        (r.qid, r.rank, r.id, r.score)
        for v in [documents.vectorize(df, weights, packed=packed)]
        for r in retrieval.top_k(v.withColumnRenamed("id", "qid"), v, k=3, **how).collect()
    }
    assert rows(True, unpack=documents.unpacked(weights)) == rows(False)


def test_vectors_and_chunks_leave_a_worker_some_rows_at_a_time(spark):
    """More rows than one batch, in order, and none lost."""
    n = 3 * documents.BATCH + 7
    df = spark.range(n).selectExpr("id", "concat('word', id, ' shared') AS text").coalesce(1)
    weights = np.ones(64)
    rows = documents.vectorize(documents.chunk_documents(df), weights).orderBy("id").collect()
    assert [r.text for r in rows] == [f"word{i} shared" for i in range(n)]
    again = documents.vectorize(df.where("id % 100 = 5"), weights).orderBy("id").collect()
    assert [r.embedding for r in rows if r.id % 100 == 5] == [r.embedding for r in again]
    batches = [pd.Series([[0], [1]] * documents.BATCH)]
    assert max(map(len, documents.vectorized(batches, weights))) <= documents.BATCH
