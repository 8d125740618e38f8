from pyspark.sql import functions as F

from routeloom.functions import paths

CASES = [
    # path, normalized, origin, strict numbers, raw origin, origin out of a set
    ("3333 1 2", "3333 1 2", 2, [3333, 1, 2], "2", False),
    ("3333 {5,6}", "3333 5", 5, None, "{5,6}", True),
    ("{5,6} 3333", "5 3333", 3333, None, "3333", False),
    ("3333 (65001 65002) 7", "3333 7", 7, None, "7", False),
    ("(65001 65002 65003)", "65002", 65002, None, "65003)", False),
    ("{}", "{}", None, None, "{}", False),
    ("abc", "abc", None, None, "abc", False),
    ("  ", None, None, None, None, False),
    ("", None, None, None, None, False),
    (None, None, None, None, None, False),
    (" 4294967295  1 ", "4294967295 1", 1, [4294967295, 1], "1", False),
]


def test_path_parsing(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, p string")
    rows = df.select(
        "i",
        paths.normalized_path("p").alias("norm"),
        paths.path_origin("p").alias("origin"),
        paths.strict_path_numbers("p").alias("strict"),
        paths.raw_origin("p").alias("raw"),
        paths.origin_is_set("p").alias("is_set"),
    ).collect()
    for r in rows:
        assert (r.norm, r.origin, r.strict, r.raw, r.is_set) == CASES[r.i][1:], CASES[r.i]


def test_communities(spark):
    df = spark.createDataFrame(
        [([(65000, 1), (None, 2), (3, None)],), ([],), (None,)], "c array<struct<asn:bigint,value:bigint>>"
    )
    assert [r[0] for r in df.select(paths.communities_text("c")).collect()] == ["65000:1 0:2 3:0", None, None]


def test_aggregator(spark):
    df = spark.createDataFrame([("65000:10.0.0.1",), ("65000:2001:db8::1",), ("65000",), (None,)], "a string")
    got = [tuple(r) for r in df.select(paths.aggregator_as("a"), paths.aggregator_address("a")).collect()]
    assert got == [("65000", "10.0.0.1"), ("65000", "2001:db8::1"), (None, None), (None, None)]


def test_asn_forms(spark):
    df = spark.createDataFrame([("AS15169",), (" AS 7 ",), ("ASAS3",), ("ASX",), ("12",)], "a string")
    got = [tuple(r) for r in df.select(paths.asked_asn("a"), paths.roa_asn("a"), paths.registry_asn("a")).collect()]
    assert got == [
        ("15169", "15169", "15169"), (" AS 7 ", "  7 ", "7"), ("AS3", "3", "3"), ("X", "X", None), ("12", "12", "12"),
    ]


def test_times(spark):
    df = spark.sql("SELECT '20250504.0800' AS t, 'bad' AS b, 0L AS z, 60L AS s")
    r = df.select(
        paths.rib_timestamp("t").cast("string"), paths.rib_timestamp("b"), paths.epoch_timestamp("z"),
        paths.epoch_timestamp("s").cast("string"),
    ).first()
    assert tuple(r) == ("2025-05-04 08:00:00", None, None, "1970-01-01 00:01:00")


def test_long_paths_on_a_default_stack(spark):
    long = " ".join(str(i) for i in range(100_000))
    df = spark.createDataFrame([(long,), (long + " {1,2}",), ("1 " * 9,)], "p string")
    assert [r[0] for r in df.select(paths.is_strict("p")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(paths.has_numbers("p")).collect()] == [True, True, True]


def test_communities_given_as_text(spark):
    df = spark.createDataFrame([("1:2 3:4", ["1:2", "3:4"]), ("", []), (None, None)], "t string, i array<string>")
    assert [r[0] for r in df.select(paths.communities_text("t", "text")).collect()] == ["1:2 3:4", None, None]
    assert [r[0] for r in df.select(paths.communities_text("i", "items")).collect()] == ["1:2 3:4", None, None]


def test_normal_paths_are_cut_not_parsed(spark):
    """A path in its normal form, and texts close to one, give what taking them apart gives."""
    forms = ["1 22 333", "7", "1 22 333\n", " 1 2", "1  2", "1 2 ", "01 2", "1 02", "0", "1 0", "1 " + "9" * 18, "1 " + "9" * 19, "1 a", "1\t2", "", None, "{1,2}", "3 {4,5}", "3 {4,5} 6", "3 (4 5) 6", "3 {"]
    df = spark.createDataFrame([(p,) for p in forms], "p string")
    numbers = paths.path_numbers("p")
    whole = F.when(F.size(numbers) > 0, F.array_join(numbers.cast("array<string>"), " ")).when(F.size(paths.path_tokens("p")) > 0, F.array_join(paths.path_tokens("p"), " "))
    got = df.select("p", paths.normalized_path("p").alias("n"), whole.alias("n2"), paths.path_origin("p").alias("o"), F.try_element_at(numbers, F.lit(-1)).alias("o2"), paths.origin_is_set("p").alias("s"))
    for r in got.collect():
        assert (r.n, r.o) == (r.n2, r.o2), r
        assert r.s == (r.p in ("{1,2}", "3 {4,5}")), r


def test_long_normal_path(spark):
    """A long path is in normal form too, and its text and last number come out whole."""
    path = " ".join(str(1 + i) for i in range(5000))
    df = spark.createDataFrame([(path,)], "p string")
    r = df.select(paths.normalized_path("p").alias("n"), paths.path_origin("p").alias("o")).first()
    assert (r.n, r.o) == (path, 5000)
    assert df.where(F.col("p").rlike(paths.NORMAL_PATH)).count() == 1
