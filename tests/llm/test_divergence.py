import random
import re
from collections import Counter, defaultdict

import numpy as np

from routeloom.llm import divergence

from .conftest import SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=30, top=50):
    """rows: (text, lang, source); every term of every group spelled out."""
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [((t or "").translate(lower), l or "", s or "") for t, l, s in rows]
    df = defaultdict(Counter)
    for t, l, _ in docs:
        df[l].update(set(TERM.findall(t)))
    vocab = {l: sorted((w for w, n in c.items() if n >= min_docs), key=str.encode) for l, c in df.items()}
    groups = defaultdict(Counter)
    langs = defaultdict(Counter)
    for t, l, s in docs:
        groups[(l, s)].update({})
        for w in TERM.findall(t):
            groups[(l, s)][w] += 1
            langs[l][w] += 1

    def probs(c, words):
        n = sum(c[w] for w in words)
        v = len(words)
        return {w: 1 + (10**9 * (c[w] + 5)) // (n + 5 * v) for w in words}

    out = set()
    for (l, s), c in groups.items():
        words = vocab.get(l, [])
        mine = probs(c, words)
        others = sorted((o for (ll, o) in groups if ll == l and o != s), key=lambda o: o.encode())
        pair = [(o, sum(abs(mine[w] - q) for w, q in probs(groups[(l, o)], words).items())) for o in others]
        for r, (o, value) in enumerate(sorted(pair, key=lambda x: (-x[1], x[0].encode())), 1):
            out.add((l, s, "pair", o, value, r))
        whole = probs(langs[l], words)
        term = [(w, mine[w] - whole[w]) for w in words if c[w] > 0 and mine[w] > whole[w]]
        for r, (w, value) in enumerate(sorted(term, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
            out.add((l, s, "term", w, value, r))
    return out


def result(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()}


def test_table_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert result(divergence.audit(docs, min_docs=5)) == plain(rows, min_docs=5)


def test_odd_rows(spark, odd_docs):
    """Nulls in text, lang and source, empty and long texts, repeated rows, clashing names; no kept term at 30."""
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    got = result(divergence.audit(odd_docs))
    assert got == plain(rows)
    assert all(value == 0 for _, _, part, _, value, _ in got if part == "pair")
    assert result(divergence.audit(odd_docs, min_docs=1)) == plain(rows, min_docs=1)


def test_ties_and_sources_without_terms(spark):
    rows = [("aa bb", "x", "s1"), ("bb aa", "x", "s2"), ("123 456", "x", "s3"), ("aa", "y", None), ("zz", "y", "t")] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(divergence.audit(df, min_docs=2)) == plain(rows, min_docs=2)


def test_empty_table(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0


def test_transducer_ordinals_and_size():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))).encode() for _ in range(3000)})
    fst = divergence.transducer(words)
    import numpy as np

    probe = words + [b"zzz", b"", b"abcdx", words[5] + b"q"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    ends = np.cumsum([len(w) for w in probe])
    got = divergence.ordinals(fst, data, ends - np.array([len(w) for w in probe]), ends)
    assert got.tolist() == list(range(len(words))) + [-1] * 4
    # minimal: fewer states than the trie of the words
    trie = len({w[:i] for w in words for i in range(len(w) + 1)})
    assert len(fst["final"]) < trie / 2


def test_transitions_by_table():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))).encode() for _ in range(2000)})
    fst = divergence.transducer(words)
    tabled = divergence.with_table(fst, 1 << 20)
    assert "table" in tabled and "table" not in divergence.with_table(fst, 100)
    probe = words + [b"zzz", b"", b"abcdx", words[5] + b"q"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    ends = np.cumsum([len(w) for w in probe])
    starts = ends - np.array([len(w) for w in probe])
    assert divergence.ordinals(tabled, data, starts, ends).tolist() == divergence.ordinals(fst, data, starts, ends).tolist()


def test_a_task_gives_each_term_out_once(spark, monkeypatch):
    """One task of 3,500 documents: a row per distinct key of each pass, not one for every thousand documents."""
    rows = [(f"aa Bb cc{i % 7 * 'd'}", "xy"[i % 2], f"s{i % 3}") for i in range(3500)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    passes = []
    plain_map = divergence.map_batches
    monkeypatch.setattr(divergence, "map_batches", lambda *a: passes.append(plain_map(*a)) or passes[-1])
    assert result(divergence.audit(df)) == plain(rows)
    assert [each.count() for each in passes] == [2 * 9, 6 * 9]


def test_a_language_that_ends_in_a_zero_character(spark):
    rows = [("aa bb", "x", "s"), ("bb cc", "x\0", "s"), ("cc", "x", "t"), ("aa", "x\0", "t")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(divergence.audit(df, min_docs=3)) == plain(rows, min_docs=3)


def coded(words):
    data = np.frombuffer("-".join(words).encode().replace(b"-", b"\0"), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    first, code = divergence.distinct(data, starts, ends)
    got = [data[starts[first[c]] : ends[first[c]]].tobytes().decode() for c in code]
    return got, len(first), divergence._strings(data, starts, ends).to_pylist()


def test_distinct_terms_by_all_their_bytes(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(4000)]
    words += ["a" * n for n in range(1, 30)] + ["a" * 5000 + "b", "a" * 5000 + "c"]
    assert coded(words) == (words, len(set(words)), words)
    # hashes of long terms that fall together, or on the bytes of a short one, do no harm
    keys = divergence.term_keys
    monkeypatch.setattr(divergence, "term_keys", lambda *a: keys(*a) % np.uint64(5))
    assert coded(words) == (words, len(set(words)), words)


def test_rows_added_up_within_a_bound(monkeypatch):
    rng = random.Random(5)
    parts = [divergence.record(k=[rng.choice("abcdefgh") for _ in range(10)], n=np.arange(10)) for _ in range(50)]
    want = Counter()
    for part in parts:
        for k, n in zip(part["k"].to_pylist(), part["n"].to_pylist()):
            want[k] += n
    for held, tables in ((1 << 19, 1), (10, 50)):
        monkeypatch.setattr(divergence, "HELD", held)
        got = Counter()
        out = list(divergence._added(iter(parts), ["k"], "n"))
        for whole in out:
            for k, n in zip(whole["k"].to_pylist(), whole["n"].to_pylist()):
                got[k] += n
        assert got == want and 1 <= len(out) <= tables
    assert list(divergence._added(iter([]), ["k"], "n")) == []
