"""Joins, windows and aggregations over requests, audits and pending items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the duration histograms, in seconds.
REQUEST_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
CHAIN_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def hourly(df: DataFrame, ts_col: str, counters: dict[str, Column]) -> DataFrame:
    """Requests and conditional counters by hour."""
    return df.groupBy(F.date_trunc("hour", ts_col).alias("hour")).agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(c).alias(k) for k, c in counters.items()])


def daily(hours: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Days and the total (null day) from hours."""
    return hours.rollup(F.to_date("hour").alias("day")).agg(*[F.sum(c).alias(c) for c in counters])


def kept_hours(hours: DataFrame, as_of: Column, keep: int = 168) -> DataFrame:
    return hours.where(F.col("hour") >= as_of - F.make_interval(hours=F.lit(keep)))


def histogram(df: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Cumulative counts up to each bound, with sum and count."""
    return df.groupBy(*by).agg(*[F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds], F.round(F.sum(value), 4).alias("total"), F.count(value).alias("n"))


def latest_live(pending: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """The newest pending item that hasn't expired, for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("confirm_id"))
    return pending.where((F.col("status") == "pending") & (F.col("expires_at") > as_of)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def only_live(pending: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Live items whose key has no other live item."""
    live = pending.where((F.col("status") == "pending") & (F.col("expires_at") > as_of))
    return live.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def recovered(pending: DataFrame, as_of: Column, timeout_s: int) -> DataFrame:
    """Items that execute for too long are pending again."""
    stale = (F.col("status") == "executing") & (F.col("updated_at") <= as_of - F.make_interval(secs=F.lit(max(timeout_s, 5))))
    return pending.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def decided(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions take effect on items that still have the expected status (compare and set)."""
    d = decisions.select("confirm_id", F.col("expected").alias("status"), "new_status")
    return pending.join(d, ["confirm_id", "status"], "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def sliding_count(df: DataFrame, key: str, ts_col: str, seconds: int = 60) -> DataFrame:
    """Events of the same key in the last ``seconds``, this one included."""
    w = Window.partitionBy(key).orderBy(F.col(ts_col).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def replays(df: DataFrame, key: str, ts_col: str, window_s: int = 300) -> DataFrame:
    """Events whose key was seen within the window before."""
    w = Window.partitionBy(key).orderBy(ts_col, "event_id")
    before = F.lag(ts_col).over(w)
    return df.withColumn("replay", F.coalesce(_seconds(F.col(ts_col)) - _seconds(before) <= window_s, F.lit(False)))


def as_of_last(df: DataFrame, key: str, ts_col: str, value_col: str, max_age_s: int, out_col: str) -> DataFrame:
    """The last value that isn't null before each row, unless it is too old (as-of join)."""
    w = Window.partitionBy(key).orderBy(ts_col, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col(value_col).isNotNull(), F.struct(F.col(ts_col).alias("t"), F.col(value_col).alias("v"))), ignorenulls=True).over(w)
    out = df.withColumn("_held", held)
    fresh = _seconds(F.col(ts_col)) - _seconds(F.col("_held.t")) <= max_age_s
    return out.withColumn(out_col, F.when(fresh, F.col("_held.v"))).drop("_held")


#: Networks that ``in_networks`` takes.
MOST_NETWORKS = 256


def in_networks(df: DataFrame, ip_col: str, networks: DataFrame) -> DataFrame:
    """Add ``label`` of the narrowest network (``low, high, label``: few rows) that holds each IPv4 address; a column of that name is replaced.

    The networks become conditions of one projection, narrowest first: no join, no
    shuffle. More than MOST_NETWORKS are an error; ``addresses.with_network`` takes any
    number, and both kinds of addresses.
    """
    listed = sorted(networks.limit(MOST_NETWORKS + 1).collect(), key=lambda r: (r["high"] - r["low"], r["low"], r["label"] or ""))
    if len(listed) > MOST_NETWORKS:
        raise ValueError(f"more than {MOST_NETWORKS} networks")
    parts = F.split(ip_col, r"\.")
    value = F.when(F.col(ip_col).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), sum((F.get(parts, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0)))
    label = F.coalesce(*(F.when(F.col("_ip").between(r["low"], r["high"]), F.lit(r["label"])) for r in listed), F.lit(None).cast("string"))
    return df.withColumn("_ip", value).withColumn("label", label).drop("_ip")


def host_rules(df: DataFrame, host_col: str, rules: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose host, or a parent of it, is listed (``host``); ``left_anti`` for the others, null hosts included.

    The different hosts' suffixes meet the list by an equi-join; the rows meet the
    hosts found on the host itself.
    """
    labels = F.split(F.lower("_host"), r"\.")
    hosts = df.select(F.col(host_col).alias("_host")).where("_host is not null").distinct()
    suffixes = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_suffix"))
    listed = rules.select(F.lower("host").alias("_suffix")).where("_suffix is not null").distinct()
    found = suffixes.join(listed, "_suffix", "left_semi").select("_host").distinct()
    return df.join(found, F.col(host_col) == F.col("_host"), how)


def masked_query(url: Column, keys: Sequence[str], mark: str = "***") -> Column:
    """An address with the values of the listed query keys masked."""
    names = "|".join(keys)
    return F.regexp_replace(url, f"(?i)([?&](?:{names})=)[^&#]*", f"$1{mark}")
