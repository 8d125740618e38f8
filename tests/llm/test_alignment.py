import hashlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from routeloom.llm import alignment, queries

from .conftest import SF


@pytest.fixture(scope="module")
def plain():
    t = alignment.Tokenizers(queries.BYTES, queries.PIECES)
    hf = Tokenizer.from_file(queries.BYTES)
    hf.encode_special_tokens = True  # the library itself, independent of the operator's encoder
    a_piece = {i: t.a_bytes[t.a_starts[i] : t.a_starts[i + 1]].tobytes() for i in range(len(t.a_len))}
    b_piece = {i: t.b_bytes[t.b_starts[i] : t.b_starts[i + 1]].tobytes() for i in range(len(t.b_len))}

    def one(text):
        text = text or ""
        a = hf.encode(" " + text, add_special_tokens=False).ids
        b = t.b.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(a_piece[i] for i in a) != want or b"".join(b_piece[i] for i in b) != want:
            return [], [], [], []
        ends_a = [sum(len(a_piece[i]) for i in a[: k + 1]) for k in range(len(a))]
        ends_b = {sum(len(b_piece[i]) for i in b[: k + 1]): k for k in range(len(b))}
        groups, links, ga, gb, j = [], [], [], [], 0
        for k, e in enumerate(ends_a):
            ga.append(a[k])
            if e in ends_b:
                m = ends_b[e]
                gb = b[j : m + 1]
                j = m + 1
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                links.append((a[k], b[m]))
                ga = []
        return a, b, groups, links

    def table(rows):
        done = [(d, *one(x)) for d, x in rows]
        count = Counter(link for *_, links in done for link in links)
        high = defaultdict(int)
        for (_, bid), n in count.items():
            high[bid] = max(high[bid], n)
        out = Counter()
        for d, a, b, groups, links in done:
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
            best = sum(count[link] == high[link[1]] for link in links)
            out[(d, len(a), len(b), len(groups), len(links), best, sum(count[link] for link in links), digest)] += 1
        return out

    return table


def result(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_table_equals_plain(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(alignment.align(docs, queries.BYTES, queries.PIECES))
    assert got == plain(rows)
    assert sum(n for k, n in got.items() if k[1] > 0) > 0.5 * len(rows)


def test_odd_rows(spark, odd_docs, plain):
    """Nulls, empty and long texts, special strings as text, repeated rows, clashing names: as the plain version."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = result(alignment.align(odd_docs, queries.BYTES, queries.PIECES))
    assert got == plain(rows)
    assert got[(1, 0, 0, 0, 0, 0, 0, "")] == 1 and got[(2, 0, 0, 0, 0, 0, 0, "")] == 1


def test_empty_table(spark, no_docs):
    assert alignment.align(no_docs, queries.BYTES, queries.PIECES).count() == 0
