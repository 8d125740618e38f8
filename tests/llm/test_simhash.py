import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from routeloom import storage
from routeloom.llm import graph, simhash

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(str.maketrans(simhash.UPPER, simhash.LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (doc_id, text); every pair compared."""
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(rows)):
        x = f[i] ^ f[i + 1 :]
        near = np.flatnonzero(np.bitwise_count(x) <= 4) + i + 1
        for j in near:
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {(d, f"{fp:016x}", least.get(find(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps))}


def result(df):
    return {(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()}


def test_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == plain_components(rows)


def test_odd_rows(spark, odd_docs):
    """Nulls, empty and long texts, ties, repeated rows (twice), clashing names: as the plain version."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == plain_components(rows)
    fp = {r.doc_id: r.fingerprint for r in got}
    assert fp[1] == fp[2] == fp[8] == "0" * 16


def test_near_texts_link_through_a_chain(spark):
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(6):  # each differs from the last in a few words
        words = list(base)
        for j in range(k * 2):
            words[j * 37 % 400] = f"x{k}{j}"
        texts.append(" ".join(words))
    rows = [(10 + k, t) for k, t in enumerate(texts)] + [(99, "something else entirely " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(simhash.near_duplicates(df)) == plain_components(rows)


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


def test_masks():
    m = simhash.masks(2)
    assert len(m) == 1 + 64 + 2016 and len(set(m)) == len(m)
    assert all(bin(x & (2**64 - 1)).count("1") <= 2 for x in m)


def test_xxhash_of_the_jvm_is_xxh64(spark):
    texts = ["", "a", "hello world one two", "Été 中文 \U0001f600" * 9]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h & (2**64 - 1) for r in got] == [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts]


def near_and_far(n=300):
    """Random fingerprints, most with no other within 4 bits, and for every tenth one at 1 to 5 differing bits."""
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**63, n)]
    for k, f in enumerate(fps[::10]):
        fps.append(f ^ sum(1 << int(b) for b in rng.choice(63, k % 5 + 1, replace=False)))
    return sorted(set(fps))


def within(fps, radius=4):
    return {(a, b) for a in fps for b in fps if b < a and (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("bucket", [256, 1])
def test_only_linkable_fingerprints_emit_variants(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # 1: no bucket is compared, all members go on
    fps = near_and_far()
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint bigint")
    linked = {f for pair in within(fps) for f in pair}
    may = {r.fingerprint for r in simhash.linkable(df).collect()}
    assert linked <= may and len(may) < len(fps) / 2
    assert may == linked or bucket == 1
    assert {(r.a, r.b) for r in simhash.links(df).collect()} == within(fps)


def test_variants_are_emitted_for_a_few_rows_only(spark):
    """What is exploded into variants was written before: the near fingerprints, not all."""
    fps = near_and_far()
    written = []
    storage.WATCHERS.append(lambda df: written.append(df))
    try:
        simhash.links(spark.createDataFrame([(f,) for f in fps], "fingerprint bigint"))
    finally:
        storage.WATCHERS.pop()
    assert written and written[-1].count() < len(fps) / 4


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_numbers_within_the_radius_agree_on_a_block_mask(radius):
    rng = np.random.default_rng(radius)
    masks = [m % 2**64 for m in simhash.block_masks(radius)]
    for _ in range(200):
        bits = rng.choice(64, radius, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)
