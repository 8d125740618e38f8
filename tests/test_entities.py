from routeloom.operators import entities, evaluate
from routeloom.schemas import ENTITY_TYPES

CASES = {
    "8.8.8.8/32 and 8.8.8.8": dict(prefixes=["8.8.8.8/32"], ip_addresses=[], asns=[]),
    "256.256.256.256/33": dict(prefixes=["256.256.256.256/33"], ip_addresses=[], asns=[]),
    "AS 701 as701 AS3356": dict(asns=["3356", "701"], ip_addresses=[], prefixes=[]),
    "ASN3356 AS-15169 AS15169s": dict(asns=[]),
    "the last one": dict(keywords=["as"], time_references=["last"]),
    "1.1.1.1 to 9.9.9.9, 1.1.1.1": dict(ip_addresses=["1.1.1.1", "9.9.9.9"]),
    "Invalid ROA Today": dict(keywords=["invalid", "roa", "valid"], time_references=["day", "today"]),
    "": dict(prefixes=[], ip_addresses=[], asns=[], keywords=[], time_references=[]),
}

TYPES = {
    "What is BGP": ["static"],
    "hello there": ["static"],
    "state of AS 7": ["live"],
    "8.8.8.8 rpki validity": ["live", "rpki"],
    "explain the history of 10.0.0.0/8 and its roa": ["static", "live", "rpki", "historical"],
    "show it since yesterday": ["historical"],
}


def test_extraction(spark):
    df = spark.createDataFrame([(q,) for q in CASES], "question string")
    for r in entities.extract_entities(df).collect():
        for name, want in CASES[r.question].items():
            assert r[name] == want, (r.question, name)


def test_classification(spark):
    df = spark.createDataFrame([(q,) for q in TYPES], "question string")
    for r in entities.classify(entities.extract_entities(df)).collect():
        assert r.query_types == TYPES[r.question], r.question


LISTS = "qid int, " + ", ".join(f"{t} array<string>" for t in ENTITY_TYPES)


def test_merge_strategies(spark):
    left = spark.createDataFrame([(1, ["1.1.1.1"], [], ["7"], ["as"], []), (2, [], [], [], [], [])], LISTS)
    right = spark.createDataFrame([(1, ["7", "8"])], "qid int, asns array<string>")
    pick = lambda s: {r.qid: (r.ip_addresses, r.asns) for r in entities.merge_extractions(left, right, strategy=s).collect()}
    assert pick("merge_results") == {1: (["1.1.1.1"], ["7", "8"]), 2: ([], [])}
    # the model has nothing for the second question: the pattern stands in
    assert pick("llm_primary") == {1: ([], ["7", "8"]), 2: ([], [])}
    assert pick("other") == {1: (["1.1.1.1"], ["7"]), 2: ([], [])}


def test_normal_forms(spark):
    cases = [
        ("asns", "AS 15169", "15169"), ("asns", "none", None), ("prefixes", "10.1.2/24", "10.1.2.0/24"), ("prefixes", "10.1.0/24", "10.1.0/24"),
        ("prefixes", "10.1/16", "10.1.0.0/16"), ("prefixes", "10/8", "10.0.0.0/8"), ("prefixes", "2001:db8::/32", "2001:db8::/32"),
        ("prefixes", "10.0.0.0", "10.0.0.0"), ("time_references", " Last Week ", "lst wk"), ("time_references", "a", None),
        ("keywords", " RPKI ", "rpki"), ("ip_addresses", " 1.1.1.1 ", "1.1.1.1"), ("keywords", "", None), ("keywords", None, None),
    ]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t string, v string")
    from pyspark.sql import functions as F

    for r in df.withColumn("n", entities.normalized_entity(F.col("t"), F.col("v"))).collect():
        assert r.n == cases[r.i][2], cases[r.i]


def test_scores(spark):
    rows = "qid int, entity_type string, value string"
    extracted = spark.createDataFrame([(2, "asns", "AS1"), (4, "asns", "1"), (4, "asns", "AS2"), (4, "asns", "2"), (5, "keywords", "x")], rows)
    truth = spark.createDataFrame([(1, "asns", None), (2, "asns", None), (3, "asns", "5"), (4, "asns", "AS2"), (4, "asns", "3")], rows)
    got = {r.qid: (r.precision, r.recall, r.f1) for r in evaluate.extraction_scores(extracted, truth).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 1.0, 0.0), 3: (1.0, 0.0, 0.0), 4: (0.5, 0.5, 0.5)}


def test_retrieval_scores(spark):
    found = spark.createDataFrame(
        [(1, 1, "rfc4271_clean.txt", "x"), (1, 2, "a", "see RFC 6811"), (1, 4, "rfc7999_clean.txt", ""), (2, 1, "b", "none")],
        "qid int, rank int, source string, content string",
    )
    expected = spark.createDataFrame([(1, ["RFC4271-9", "RFC4271-1", "RFC6811-2", "RFC7999-1"]), (2, ["RFC1-1"]), (3, [])], "qid int, expected_docs array<string>")
    matches = evaluate.retrieval_matches(found, expected)
    assert {(r.qid, r.number): r.matched for r in matches.collect()} == {
        (1, "4271"): True, (1, "6811"): True, (1, "7999"): False, (2, "1"): False, (3, None): False,
    }
    r = evaluate.retrieval_scores(matches).first()
    assert (r.total_queries, r.hit_rate_at_k, r.precision, r.recall) == (3, 1 / 3, 2 / 9, 2 / 4)
    empty = evaluate.retrieval_scores(matches.where("qid > 9")).first()
    assert (empty.total_queries, empty.hit_rate_at_k, empty.precision, empty.f1_score) == (0, None, 0.0, 0.0)


def test_timings(spark):
    df = spark.createDataFrame([("total_pipeline", 4.0), ("total_pipeline", 6.0), ("x", 1.0)], "component string, seconds double")
    got = {r.component: (r.mean, round(r.std_dev, 6), r.min, r.max, r.percentage) for r in evaluate.timing_stats(df).collect()}
    assert got == {"total_pipeline": (5.0, 1.414214, 4.0, 6.0, 100.0), "x": (1.0, 0.0, 1.0, 1.0, 20.0)}


def test_word_lists_are_the_fixed_ones():
    assert entities.KEYWORDS == "route prefix path bgp origin as rpki roa routing announce valid invalid peer hijack".split()
    assert entities.TIME_WORDS == "yesterday today now current hour minute week month day ago since last this recent".split()
    assert entities.RPKI_WORDS == ["rpki", "roa", "valid"] and entities.HISTORY_WORDS == ["history", "historical"]
    assert len(entities.STATIC_PHRASES) == 13 and "border gateway protocol" in entities.STATIC_PHRASES


def test_model_extraction_shuffles_once(spark):
    """Rows of a question come together in one shuffle, with nothing combined and sorted before it."""
    from routeloom.plans import text_queries

    model = text_queries.model_extraction(spark, "/root/testdata/sf0.001")
    plan = model._jdf.queryExecution().sparkPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert "Aggregate" not in before and "Aggregate" in plan
    rows = model.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").distinct().count()
    assert all(r.asns == [str(1000 + r.qid % 5)] and None not in r.prefixes + r.ip_addresses for r in rows)
