"""Each stage against plain means, on what the one before kept."""

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from routeloom.llm import personal_data, queries
from routeloom.llm.common import kept

from .test_ngram_join import brute
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], SF)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == docs.columns and [f.dataType for f in out[-1].schema] == [f.dataType for f in docs.schema]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(spark, steps):
    stay, labels = rows(steps[1]), rows(spark.read.parquet(f"{SF}/labels.parquet"))
    good = [i in stay for i, r in labels.items() if r.quality == 1]
    bad = [i in stay for i, r in labels.items() if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
    assert all(rows(steps[0])[i] == r for i, r in stay.items())


def test_exact_copies(steps):
    best = {}
    for i, r in rows(steps[1]).items():
        best[r.text] = max(i, best.get(r.text, i))
    assert set(rows(steps[2])) == set(best.values())


def test_near_copies(steps):
    classes = {c for _, c, *_ in brute([(i, r.text) for i, r in rows(steps[2]).items()])}
    assert set(rows(steps[3])) == classes


def test_private_data(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        spans = personal_data.base_spans(r.text)
        if spans:
            changed += 1
            assert after[i].text != r.text and not personal_data.base_spans(after[i].text)
            assert after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == r
    assert changed


def test_packing(steps):
    library = Tokenizer.from_file(queries.BYTES)
    check_packing(steps[5].collect(), [(i, r.text) for i, r in rows(steps[4]).items()], lambda t: library.encode(t or "", add_special_tokens=False).ids + [0], 1024)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert (out.count() > 0) == (docs is odd_docs)
