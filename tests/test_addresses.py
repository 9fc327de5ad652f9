"""Addresses and networks against the standard library, and host rules."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidewarden.functions import patterns
from tidewarden.operators import addresses, records

ODD = ["", " ", "no", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8:", ":1::8", "12345::", "g::", "::1.2.3.4", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "::1.2.3", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4:5", None]


def parsed(text):
    try:
        a = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return ipaddress.IPv6Address(f"::ffff:{a}") if a.version == 4 else a


def is_blocked(text):
    a = parsed(text)
    if a is None:
        return None
    a = a.ipv4_mapped or a
    return not a.is_global or a.is_reserved


def samples():
    rng = random.Random(9)
    out = list(ODD)
    for c in patterns.BLOCKED_NETWORKS + patterns.GLOBAL_NETWORKS:
        net = ipaddress.ip_network(c)
        for n in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1, rng.randrange(int(net[0]), int(net[-1]) + 1)):
            if 0 <= n < 1 << net.max_prefixlen:
                a = ipaddress.ip_address(n) if net.version == 4 else ipaddress.IPv6Address(n)
                out += [str(a), *([a.exploded, str(a).upper()] if net.version == 6 else [f"::ffff:{a}"])]
    out += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    return out


def test_bits_and_blocked(spark):
    df = spark.createDataFrame([(x, "mine") for x in samples()], "ip string, label string")
    for r in addresses.blocked(df.withColumn("bits", addresses.address_bits(F.col("ip"))), "ip").collect():
        a = parsed(r["ip"])
        assert r["bits"] == (None if a is None else f"{int(a) & ((1 << 128) - 1):0128b}"), r["ip"]
        assert r["blocked"] == is_blocked(r["ip"]), r["ip"]
        assert r["label"] == "mine"


def test_many_networks_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(samples() * 2)], "ip string, i int")
    few = {r["i"]: r["network"] for r in addresses.with_network(df, "ip", addresses.special_networks(df)).collect()}
    monkeypatch.setattr(addresses, "FEW", 3)
    many = {r["i"]: r["network"] for r in addresses.with_network(df, "ip", addresses.special_networks(df)).collect()}
    assert few == many and len(few) == df.count() and None in few.values()
    assert addresses.with_network(df, "ip", addresses.special_networks(df).where("false")).where("network is not null").count() == 0


def test_longest_network_wins_without_shuffle(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "narrow"), ("2000::/3", "six"), ("bad/8", "x")], "cidr string, label string")
    out = addresses.with_network(spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("::ffff:10.1.0.0",), ("2600::1",), ("fe80::1",)], "ip string"), "ip", nets)
    assert [r["network"] for r in out.collect()] == ["narrow", "wide", "narrow", "six", None]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_host_rules_with_repeated_and_odd_rows(spark):
    df = spark.createDataFrame([("A.b.example.com", 1), ("a.b.example.com", 2), ("a.b.example.com", 2), ("example.org", 3), ("", 4), (None, 5)], "h string, host int")
    rules = spark.createDataFrame([("example.com",), ("EXAMPLE.com",), (None,)], "host string")
    assert sorted(r["host"] for r in records.host_rules(df, "h", rules).collect()) == [1, 2, 2]
    assert sorted(r["host"] for r in records.host_rules(df, "h", rules, "left_anti").collect()) == [3, 4, 5]


def test_in_networks_keeps_a_column_of_that_name_apart(spark):
    nets = spark.createDataFrame([(10 << 24, (11 << 24) - 1, "private")], "low long, high long, label string")
    out = records.in_networks(spark.createDataFrame([("10.0.0.7", 1), ("10.0.0.7", 1)], "ip string, low int"), "ip", nets)
    assert out.columns == ["ip", "low", "label"] and [tuple(r) for r in out.collect()] == [("10.0.0.7", 1, "private")] * 2
