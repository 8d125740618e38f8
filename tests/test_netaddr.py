import ipaddress
import random

from routeloom.functions import netaddr


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def expected_key(text):
    try:
        net = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    value = int(net.network_address)
    if net.version == 4:
        return (4, value, 0, net.prefixlen)
    return (6, signed(value >> 64), signed(value & ((1 << 64) - 1)), net.prefixlen)


FIXED = [
    "0.0.0.0/0", "10.1.2.3/8", "255.255.255.255/32", "256.1.1.1/8", "1.2.3/8", "1.2.3.4/33", "01.2.3.4/8", "1.2.3.4",
    "::/0", "2001:db8::/32", "::1/128", "::ffff:1.2.3.4/128", "2001:db8::1::2/64", "::/129", "1:2:3:4:5:6:7:8/64",
    "1:2:3:4:5:6:7::/112", "1:2:3:4:5:6:7:8::/64", ":1:2:3:4:5:6:7:8/64", "1:2:3:4:5:6:7:8:/64", "::2:3:4:5:6:7:8/16",
    "fe80::1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/127", "12345::/16", "g::/16", "::1.2.3.400/128", "1::1.2.3.4/96",
    "1:2:3:4:5:6:1.2.3.4/120", "", "/", "abc", "10.0.0.0/x", "10.0.0.0/",
]


def samples():
    rng = random.Random(7)
    out = list(FIXED)
    for _ in range(300):
        out.append(f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}")
        bits = rng.getrandbits(128) & rng.getrandbits(128) if rng.random() < 0.5 else rng.getrandbits(128)
        if rng.random() < 0.5:
            for _ in range(4):
                bits &= ~(0xFFFF << (16 * rng.randint(0, 7)))
        out.append(f"{ipaddress.IPv6Address(bits)}/{rng.randint(0, 128)}")
    return out


def test_network_key_and_text_match_ipaddress(spark):
    df = spark.createDataFrame([(t,) for t in samples()], "prefix string")
    keyed = netaddr.with_network(df, drop_invalid=False)
    for row in netaddr.with_canonical_text(keyed, "text").collect():
        want = expected_key(row.prefix)
        got = None if row.family is None else (row.family, row.net_hi, row.net_lo, row.plen)
        assert got == want, row
        if want is not None:
            net = ipaddress.ip_network(row.prefix, strict=False)
            if not (net.version == 6 and net.network_address.ipv4_mapped):
                assert row.text == str(net), row


def test_invalid_prefixes_are_dropped(spark):
    df = spark.createDataFrame([("256.1.1.1/8",), ("10.0.0.1/8",)], "prefix string")
    assert [r.net_hi for r in netaddr.with_network(df).collect()] == [10 << 24]


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("::1",), ("300.1.1.1",)], "ip string")
    rows = netaddr.with_address(df, "ip").collect()
    assert [(r.family, r.hi, r.lo) for r in rows] == [(4, 0x01020304, 0), (6, 0, 1)]
