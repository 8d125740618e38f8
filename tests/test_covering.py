import ipaddress
import random

from routeloom.operators import covering, rib


def networks(seed, n4=150, n6=120):
    rng = random.Random(seed)
    out = ["0.0.0.0/0", "::/0"]
    for _ in range(n4):
        out.append(f"10.{rng.randint(0, 7)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}/{rng.randint(4, 32)}")
    for _ in range(n6):
        out.append(f"2001:db8:{rng.randint(0, 3):x}:{rng.randint(0, 3):x}::{rng.randint(0, 9):x}/{rng.choice([16, 32, 48, 56, 63, 64, 65, 100, 128])}")
    return out


def addresses(seed):
    rng = random.Random(seed)
    v4 = [f"10.{rng.randint(0, 9)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(200)]
    v6 = [f"2001:db8:{rng.randint(0, 4):x}:{rng.randint(0, 4):x}::{rng.randint(0, 9):x}" for _ in range(200)]
    return v4 + v6 + v4[:20] + ["256.1.1.1", "x"]


def test_longest_match_equals_brute_force(spark):
    nets = networks(1)
    state = rib.snapshot(spark.createDataFrame([(i, n, f"1 {i + 1}") for i, n in enumerate(nets)], "seq bigint, prefix string, as_path string"))
    last = {ipaddress.ip_network(n, strict=False): i + 1 for i, n in enumerate(nets)}
    asked = addresses(2)
    got = covering.longest_match(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, ip string"), state).collect()
    assert len(got) == len(asked)
    for r in got:
        try:
            a = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.matching_prefix is None
            continue
        best = max((n for n in last if n.version == a.version and a in n), key=lambda n: n.prefixlen)
        assert (r.matching_prefix, r.origin_as) == (str(best), last[best])


def test_no_match_keeps_or_drops_the_address(spark):
    state = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/8", "1")], "seq bigint, prefix string, as_path string"))
    asked = spark.createDataFrame([("11.0.0.1",)], "ip string")
    assert covering.longest_match(asked, state).first().matching_prefix is None
    assert covering.longest_match(asked, state, how="inner").count() == 0


def test_exact_lookup_ignores_host_bits(spark):
    state = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/8", "1 2"), (2, "2001:db8::/32", "3")], "seq bigint, prefix string, as_path string"))
    asked = spark.createDataFrame([("10.1.1.1/8",), ("10.0.0.0/9",), ("2001:DB8:0::/32",), ("bad",)], "prefix string")
    got = covering.exact_lookup(asked, state).collect()
    assert sorted((r.prefix, r.matching_prefix, r.origin_as) for r in got) == [
        ("10.1.1.1/8", "10.0.0.0/8", 2), ("2001:DB8:0::/32", "2001:db8::/32", 3),
    ]


def test_origin_validation_equals_brute_force(spark):
    rng = random.Random(5)
    vrps = [(n, int(n.split("/")[1]) + rng.randint(0, 4), rng.randint(0, 3)) for n in networks(6)[2:]]
    routes = [(n, rng.choice([1, 2, 3, None]), rng.random() < 0.1) for n in networks(7)]
    routes += routes[:10]
    got = covering.validate_origins(
        spark.createDataFrame(routes, "prefix string, origin_as bigint, origin_is_set boolean"),
        spark.createDataFrame(vrps, "prefix string, max_length int, asn bigint"),
    ).collect()
    want = set()
    for prefix, origin, is_set in set(routes):
        net = ipaddress.ip_network(prefix, strict=False)
        cover = [(m, a) for p, m, a in vrps for v in [ipaddress.ip_network(p, strict=False)] if v.version == net.version and net.subnet_of(v)]
        ok = not is_set and any(a and a == origin and net.prefixlen <= m for m, a in cover)
        want.add((prefix, origin, is_set or origin is None, len(cover), "valid" if ok else "invalid" if cover else "not-found"))
    assert {(r.prefix, r.origin_as, r.origin_is_none, r.covering_vrps, r.rpki_status) for r in got} == want


def test_routes_are_looked_up_by_network(spark):
    """Many texts and origins of one network are one probe row a length, and origins only where a length is allowed."""
    routes = [(f"10.{i}.0.1/8", 1000 + i % 3, False) for i in range(200)] + [("10.1.2.0/24", 1000, False), ("x", 1, False), (None, 1, False), ("11.0.0.0/8", 5, True)]
    vrps = [("10.0.0.0/8", None, 1000), ("10.1.0.0/16", 24, 1000), ("0.0.0.0/0", 4, 1002), ("10.0.0.0/8", 30, 0)]
    probed = []
    salted = covering.network_probes

    def counted(rows, *args, **kwargs):
        probed.append(rows.count())
        return salted(rows, *args, **kwargs)

    covering.network_probes = counted
    try:
        got = covering.validate_origins(spark.createDataFrame(routes, "prefix string, origin_as bigint, origin_is_set boolean"), spark.createDataFrame(vrps, "prefix string, max_length int, asn bigint"))
        rows = {(r.prefix, r.origin_as): (r.origin_is_none, r.covering_vrps, r.rpki_status) for r in got.collect()}
    finally:
        covering.network_probes = salted
    # 10/8, 10.1/16 (for 10.1.2/24) and 0/0 (for 11/8); 10/8 of three origins and 10.1.2/24 of one
    assert probed == [3, 4]
    assert len(rows) == len(routes)
    assert rows[("10.0.0.1/8", 1000)] == (False, 3, "valid") and rows[("10.1.0.1/8", 1001)] == (False, 3, "invalid")
    assert rows[("10.2.0.1/8", 1002)] == (False, 3, "invalid")
    assert rows[("10.1.2.0/24", 1000)] == (False, 4, "valid")
    assert rows[("x", 1)] == rows[(None, 1)] == (False, 0, "not-found") and rows[("11.0.0.0/8", 5)] == (True, 1, "invalid")
