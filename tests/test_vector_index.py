import pytest
from pyspark.sql import functions as F

from routeloom.operators import retrieval, vector_index
from routeloom.plans import document_queries as dq


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_the_exact_way(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding").cache()
    corpus = vectors.select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.id) for r in retrieval.top_k(asked, corpus, exclude_same=True).collect()}
    got = dq.similarity_ivf(spark, f"/root/testdata/sf{sf}").collect()
    assert len(got) == len(exact)  # every vector gets three
    found = {(r.qid, r.id) for r in got}
    assert len(found & exact) / len(exact) >= 0.9


def test_hot_vector_and_nulls(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(50)] + [(100 + i, [0.0, 1.0, float(i)]) for i in range(20)] + [(999, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    centroids = vector_index.fit(df, 3)
    got = vector_index.top_k(df.withColumnRenamed("id", "qid"), df, centroids, k=3, probes=3, exclude_same=True).collect()
    assert {r.qid for r in got} == {i for i, v in rows if v is not None}
    assert all(r.score == pytest.approx(1.0) for r in got if r.qid < 50)


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, embedding array<double>")
    assert vector_index.fit(df, 4).size == 0
