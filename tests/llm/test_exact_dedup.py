"""The cuckoo-filter index and exact deduplication against plain dictionaries."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeloom.llm import exact_dedup, queries

from .conftest import SF


def sha(i) -> str:
    return hashlib.sha256(str(i).encode()).hexdigest()


def test_shard_inserts_deletes_and_resizes():
    rng, shard, live = random.Random(7), exact_dedup.Shard(buckets=1), {}
    for step in range(6000):
        d = sha(rng.randrange(1500))
        if rng.random() < 0.4:
            assert shard.delete(d) == (live.pop(d, None) is not None)
        elif d not in live:
            live[d] = step
            shard.insert(d, [1, step, step, 1])
    assert shard.buckets > 64
    assert {d: e[1] for b in shard.content.values() for d, e in b.items()} == live
    assert all((shard.find(sha(i)) is not None) == (sha(i) in live) for i in range(1500))
    assert (shard.table > 0).sum() == len(live)


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), sha_text(text)) for i in ids]
    return sorted(out, key=str), {text: (max((i for i in ids if i is not None), default=None)) for text, ids in groups.items()}


def sha_text(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_deduplicate(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want, keep = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = exact_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sorted((r.text_sha256 for r in got if r.kept)) == sorted(map(sha_text, keep))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.unique(docs)
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in stay.collect()), key=str) == sorted(((i, t) for t, i in keep.items()), key=str)


def test_no_rows(no_docs):
    assert exact_dedup.deduplicate(no_docs).count() == 0
    assert exact_dedup.unique(no_docs).count() == 0


def test_index_across_batches(spark):
    def arriving(ids):
        return exact_dedup.digests(spark.createDataFrame([(i, f"text {i % 50}") for i in ids], "doc_id bigint, text string"))

    first = exact_dedup.kept(exact_dedup.update(None, arriving(range(60)), None, 3))
    gone = spark.createDataFrame([(hashlib.sha256(f"text {i}".encode()).hexdigest(),) for i in (0, 7, 1000)], "text_sha256 string")
    second = exact_dedup.update(first, arriving(range(100, 110)), gone, 3)
    rows = {r.digest: (r.keep_id, r.copies) for r in second.collect()}
    want = {}
    for i in list(range(60)):
        k = hashlib.sha256(f"text {i % 50}".encode()).hexdigest()
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    for i in (0, 7):
        del want[hashlib.sha256(f"text {i}".encode()).hexdigest()]
    for i in range(100, 110):
        k = hashlib.sha256(f"text {i % 50}".encode()).hexdigest()
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    assert rows == want
    assert second.where(F.col("shard") >= 3).count() == 0
    assert queries.ORACLES["op3_exact_dedup"]
