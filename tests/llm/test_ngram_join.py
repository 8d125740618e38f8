"""The join against all pairs compared."""

import random
import re
from collections import defaultdict

import pytest

from routeloom.llm import ngram_join, queries

from .conftest import SF


def brute(rows, n=5, threshold=0.8):
    """(doc_id, text) -> (class_id, n_links, n_texts, copies) by row."""
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if len(ws) >= n else frozenset([tuple(ws)] if ws else []))
    by_gram = defaultdict(set)
    distinct = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            distinct[s].append(i)
    for s in distinct:
        for g in s:
            by_gram[g].add(s)
    linked = {}
    for s in distinct:
        near = set().union(*(by_gram[g] for g in s)) - {s}
        linked[s] = [t for t in near if len(s & t) / len(s | t) >= threshold]
    parent = {s: s for s in distinct}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for s, ts in linked.items():
        for t in ts:
            parent[top(s)] = top(t)
    least = defaultdict(list)
    for s, own in distinct.items():
        least[top(s)] += [rows[i][0] for i in own]
    out = []
    for (doc_id, _), s in zip(rows, sets):
        if not s:
            out.append((doc_id, doc_id, 0, 0, 1))
            continue
        known = [i for i in least[top(s)] if i is not None]
        out.append((doc_id, min(known) if known else None, sum(len(distinct[t]) for t in linked[s]) + len(distinct[s]) - 1, len(linked[s]), len(distinct[s])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.copies) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = ngram_join.bands_for(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 160


def test_documents(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        found = queries.QUERIES["op6_ngram_join"](spark, sf)
        assert got(found) == brute(docs)
        assert found.where("kept").count() == found.select("class_id").distinct().count()


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.join(df)) == brute(rows)
    kept = ngram_join.representatives(df).collect()
    assert len(kept) == len({c for _, c, *_ in brute(rows)})


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(ngram_join.join(odd_docs)) == brute(rows)
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.representatives(no_docs).count() == 0
    stay = ngram_join.representatives(odd_docs)
    assert stay.columns == odd_docs.columns
    assert sorted((str(r.doc_id) for r in stay.collect())) == sorted(str(i) for i in (0, 1, 2, None, 4, 5, 6, 7, 8, 9, 20))


def test_components(spark):
    edges = [(i, i // 2) for i in range(40)] + [(i, (i + 1) // 2 + 1000) for i in range(40)] + [(100, 5000), (101, 5000)]
    labels = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "node bigint, group bigint")).collect()}
    assert labels == {i: 0 for i in range(40)} | {100: 100, 101: 100}
