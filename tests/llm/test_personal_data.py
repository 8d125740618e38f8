"""Fixed patterns against the plain ones, and discovery in contexts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import personal_data, queries

from .conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


texts = st.lists(st.sampled_from(["a", "b.c", "@", ".", "d-e", "é", "1", "25", "256", "0", " ", "-", "+1", "(5)", "4111 1111 1111 1111", "1.2.3.4", "\n", "%", "555-01", "x@y.z"]), max_size=25).map("".join)


@settings(max_examples=800, deadline=None)
@given(texts)
def test_fixed_patterns(text):
    got = [(personal_data.KINDS[k], s, e) for k, s, e in personal_data.base_spans(text)]
    assert got == plain(text)


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1", "1 ", "a.", "@a", "1@"])
def test_long_runs_take_linear_time(piece):
    text = piece * 60000
    personal_data.contexts(text, personal_data.base_spans(text))


def test_documents(spark):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op7_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in PLAIN]
        if not r.n_added:
            assert r.spans == joined(spans)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please write to user{i}@mail.example now, or call 12 people.") for i in range(10)]
    rows += [(20, "Please WRITE to bob7(at)mail now."), (21, "They went to 42 places."), (22, "é write to carol(at)mail"), (23, "write to\nbob8(at)mail")]
    found = {r.doc_id: r for r in personal_data.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[20].spans == "email:16:28" and found[20].n_added == 1 and found[20].n_email == 0
    assert all(found[i].n_added == 0 for i in (*range(10), 21, 22, 23))
    assert found[3].spans == "email:16:34"


@pytest.mark.parametrize(
    "before, seeds, kind, texts",
    [
        ("call me on", ["+44 20 7946 09%02d" % i for i in range(9)], "phone", ["555 123 4567", "(555) 123-4567", "555.123.4567", "555 (123) 4567"]),
        ("pay with card", ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881"] * 4, "card", ["4111 1111 1111 1112", "4111-1111-1111-1112"]),
    ],
)
def test_numbers_in_groups_are_found_whole(spark, before, seeds, kind, texts):
    rows = [(i, f"Please {before} {x} today.") for i, x in enumerate(seeds)] + [(100 + i, f"Do {before} {x}, thanks 12 times.") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in personal_data.report(df).collect()}
    out = {r.doc_id: r.text for r in personal_data.redacted(df).collect()}
    for i, x in enumerate(texts):
        at = len(f"Do {before} ")
        assert (found[100 + i].spans, found[100 + i].n_added) == (f"{kind}:{at}:{at + len(x)}", 1)
        assert out[100 + i] == f"Do {before} <{kind.upper()}>, thanks 12 times."


def test_tokens_carry_evidence_to_other_contexts(spark):
    """Seeds make names likely, these bear out a context without seeds, and it another name; each is marked anywhere."""
    rows = [(i, f"Please write to user{i}@mail.example now.") for i in range(30)]
    rows += [(100 + i, f"Please write to person{i}(at)mail now.") for i in range(6)]
    rows += [(200 + i, f"My own handle is person{i}(at)mail here.") for i in range(6)]
    rows += [(300, "My own handle is stranger77(at)mail here."), (301, "A word from stranger77(at)mail on this."), (302, "A word from person1(at)mail on this."), (303, "A word from other55(at)mail on this.")]
    found = {r.doc_id: r for r in personal_data.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[300].spans == "email:17:35"
    assert found[301].spans == "email:12:30" and found[302].spans == "email:12:27"
    assert found[303].n_added == 0


def test_a_context_does_not_bear_itself_out(spark):
    """One seed, many times, and tokens that only its context makes likely."""
    rows = [(i, "Build of host 10.1.2.3 is done.") for i in range(30)] + [(100 + i, f"Build of host release{i} is done.") for i in range(5)]
    assert all(r.n_added == 0 for r in personal_data.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a b@c.de, 1.2.3.4 z", "x"), (2, None, "y"), (3, "clean", None), (4, "x 4111 1111 1111 1111", "q")], "doc_id bigint, text string, base string")
    out = {r.doc_id: r for r in personal_data.redacted(df).collect()}
    assert out[1].text == "a <EMAIL>, <IP> z" and out[1].base == "x"
    assert out[2].text is None and out[3].text == "clean" and out[3].base is None
    assert personal_data.redacted(df).columns == df.columns
    assert "4111" not in out[4].text


def test_odd_rows(odd_docs, no_docs):
    rows = personal_data.report(odd_docs).collect()
    want = sorted(((r.doc_id, joined(plain(r.text or ""))) for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.spans) for r in rows), key=str) == want
    assert personal_data.report(no_docs).count() == 0
    assert sorted((str(r.doc_id) for r in personal_data.redacted(odd_docs).collect())) == sorted(str(r.doc_id) for r in odd_docs.collect())
