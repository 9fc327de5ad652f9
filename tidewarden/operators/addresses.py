"""IP addresses: both kinds as 128 bits, and longest-prefix matches against networks.

An address becomes a text of 128 bits, IPv4 as its IPv4-mapped IPv6 form, so a
mapped address and the plain one are the same. A network is the text of its first
bits; the longest network that an address begins with is its network. Only the
prefix lengths in use are tried, longest first. Few networks are looked up in a
constant map inside the projection, without shuffle; many by an equi-join of the
different addresses' prefixes, whose result is joined back on the address.

Defined results: null, and what is no address (leading zeros, more than one ``::``,
groups over four digits), has no bits and no network. A zone (``%eth0``) is ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed

#: Networks that a constant map may hold.
FEW = 256
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
_NO_GROUPS = "array<string>"


def _hex_of_v4(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.concat(*(F.lpad(F.lower(F.hex(F.get(parts, F.lit(i)).cast("int"))), 2, "0") for i in range(4)))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast(_NO_GROUPS)).otherwise(F.split(side, ":", -1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hex_of_v6(ip: Column) -> Column:
    """32 hex digits of an address with colons, null where it is none."""

    def with_tail(tail: Column) -> Column:
        return F.when(tail != "", F.concat(F.regexp_replace(ip, r"[0-9.]+$", ""), F.substring(_hex_of_v4(tail), 1, 4), F.lit(":"), F.substring(_hex_of_v4(tail), 5, 4))).otherwise(ip)

    def by_halves(halves: Column) -> Column:
        left, right = _groups(F.get(halves, F.lit(0))), F.coalesce(_groups(F.get(halves, F.lit(1))), F.array().cast(_NO_GROUPS))
        return F.when(F.size(halves) <= 2, _let(F.struct(left.alias("l"), right.alias("r"), (F.size(halves) == 2).alias("short")), by_groups))

    def by_groups(g: Column) -> Column:
        n = F.size(g["l"]) + F.size(g["r"])
        whole = F.concat(g["l"], F.array_repeat(F.lit("0"), F.when(g["short"], 8 - n).otherwise(0)), g["r"])
        good = F.when(g["short"], n <= 7).otherwise(n == 8)
        return F.when(good & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

    plain = _let(F.regexp_extract(ip, rf"^.*:({_V4})$", 1), with_tail)
    return _let(F.split(plain, "::", -1), by_halves)


def address_bits(ip: Column) -> Column:
    """The 128 bits of an address, as a text of 0 and 1."""

    def digits(low: Column) -> Column:
        six = F.regexp_replace(low, r"%[^%]+$", "")
        four = F.concat(F.lit("0" * 20 + "ffff"), _hex_of_v4(low))
        return F.when(low.rlike(rf"^{_V4}$"), four).when(low.contains(":") & ~low.contains(":::"), _let(six, _hex_of_v6))

    # each digit by way of a letter that is no digit
    bits = F.translate(_let(F.lower(F.trim(ip)), digits), "0123456789abcdef", "ghijklmnopqrstuv")
    for i, letter in enumerate("ghijklmnopqrstuv"):
        bits = F.replace(bits, F.lit(letter), F.lit(f"{i:04b}"))
    return bits


def network_prefix(cidr: Column) -> Column:
    """The first bits of a network ``address/length``."""
    address, length = F.substring_index(cidr, "/", 1), F.substring_index(cidr, "/", -1).cast("int")
    return F.substring(address_bits(address), F.lit(1), length + F.when(address.contains(":"), 0).otherwise(96))


def special_networks(df: DataFrame) -> DataFrame:
    """The networks that aren't global or are reserved, and those inside them that are (``cidr, label``)."""
    rows = [(c, "blocked") for c in fixed.BLOCKED_NETWORKS] + [(c, "global") for c in fixed.GLOBAL_NETWORKS]
    return df.sparkSession.createDataFrame(rows, "cidr string, label string")


def with_network(df: DataFrame, ip_col: str, networks: DataFrame, out_col: str = "network") -> DataFrame:
    """Add the label of the longest network (``cidr, label``) that holds each address; a column of that name is replaced."""
    listed = networks.select(network_prefix(F.col("cidr")).alias("_p"), "label").where("_p is not null").groupBy("_p").agg(F.min("label").alias("label"))
    lengths = sorted((r[0] for r in listed.select(F.length("_p")).distinct().collect()), reverse=True)  # 129 at most
    if not lengths:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    few = listed.limit(FEW + 1).collect()
    if len(few) <= FEW:
        known = {n: [F.lit(x) for r in few if len(r["_p"]) == n for x in (r["_p"], r["label"])] for n in lengths}
        rows = df.withColumn("_bits", address_bits(F.col(ip_col)))
        return rows.withColumn(out_col, F.coalesce(*(F.try_element_at(F.create_map(*known[n]), F.substring("_bits", 1, n)) for n in lengths))).drop("_bits")
    different = df.select(F.col(ip_col).alias("_ip")).where("_ip is not null").distinct().withColumn("_bits", address_bits(F.col("_ip")))
    asked = different.where("_bits is not null").select("_ip", F.explode(F.array(*(F.substring("_bits", 1, n) for n in lengths))).alias("_p"))
    found = asked.join(listed, "_p").groupBy("_ip").agg(F.max_by("label", F.length("_p")).alias("_label"))
    return df.drop(out_col).join(found, F.col(ip_col) == F.col("_ip"), "left").withColumn(out_col, F.col("_label")).drop("_ip", "_label")


def blocked(df: DataFrame, ip_col: str, out_col: str = "blocked") -> DataFrame:
    """Add whether an address is not globally routable or reserved; null for what is no address."""
    # an address outside all of them is global; bits that are null find no network either
    everything = df.sparkSession.createDataFrame([("::/0", "global")], "cidr string, label string")
    held = with_network(df, ip_col, special_networks(df).unionByName(everything), "_special")
    return held.withColumn(out_col, F.col("_special") == "blocked").drop("_special")
