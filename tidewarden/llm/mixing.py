"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its share of the target weights, times the
bytes of the whole corpus and ``epochs``, over its own bytes. Each document is
repeated ``Poisson(rate)`` times; the count is the inverse of the Poisson
distribution at a uniform number hashed from seed and id, so a run can be
repeated and a document's count doesn't depend on any other row but through the
rates. The copies are then dealt to partitions and sorted by a hash: a global
shuffle in one exchange, on a key without hot values.

Built from DataFrame functions only. Sources that ``weights`` doesn't name
(null among them) share ``other_weight`` as one group, so the rates that reach
the driver are one more than the named weights at most.

Defined results: sizes count UTF-8 bytes plus one, so empty and null texts take
part; equal ids have equal counts; a group without rows has no share of the
weights; an empty table gives an empty table. ``mix_sources`` adds ``rate``,
``copies``, ``copy`` and ``shuffle_key`` and replaces columns of these names;
``mixed_rows`` returns the input's columns alone, all with their own values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson means above this are drawn as sums of equal parts, each with its own hash.
PART_MEAN = 16.0


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(mean: float) -> list[float]:
    """P(count <= k) for k = 0, 1, … up to where the rest is below 2**-53."""
    term = total = math.exp(-mean)
    steps = [total]
    k = 0
    while k <= mean or term > 2.0**-53 * total:
        k += 1
        term = term * mean / k
        total += term
        steps.append(total)
    return steps


def poisson_count(mean: float, seed: str, key: Column) -> Column:
    """A Poisson count with this mean, hashed from seed and key."""
    parts = max(1, math.ceil(mean / PART_MEAN))
    steps = F.array(*[F.lit(x) for x in poisson_steps(mean / parts)])
    if parts == 1:
        u = hashed_uniform(seed, "0", key)
        return F.size(F.filter(steps, lambda p: p <= u))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        F.lit(0),
        lambda acc, i: acc + F.size(F.filter(steps, lambda p: p <= hashed_uniform(seed, i, key))),
    )


def source_rates(df: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> dict[str | None, float]:
    """The repetition rate of each named source, and under None that of all others."""
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col))
    sizes = df.groupBy(named.alias("s")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("b"))
    size = {r["s"]: int(r["b"]) for r in sizes.collect()}  # bounded by the named weights
    weight = {s: float(weights[s] if s is not None else other_weight) for s in size}
    total, share = float(sum(size.values())), sum(weight.values())
    return {s: epochs * (weight[s] / share) * total / size[s] if share else 0.0 for s in size}


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def mix_sources(df: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Repeat rows so that each source's expected bytes follow its weight, and shuffle.

    Adds ``rate``, ``copies``, ``copy`` (from 0) and ``shuffle_key``.
    """
    mixed, added = _mixed(df, weights, other_weight, epochs, seed, id_col, source_col, text_col)
    own = [c for c in df.columns if c not in added]
    return mixed.select(*own, *[F.col(held).alias(name) for name, held in added.items()])


def mixed_rows(df: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``mix_sources`` with the columns of ``df`` only."""
    return _mixed(df, weights, other_weight, epochs, seed, id_col, source_col, text_col)[0].select(*df.columns)


def _mixed(df: DataFrame, weights: dict[str, float], other_weight: float, epochs: float, seed: str, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The repeated and shuffled rows, and the names under which the added columns are held."""
    rates = source_rates(df, weights, other_weight, epochs, source_col, text_col)
    rate, copies = F.lit(0.0), F.lit(0)
    for source, mean in rates.items():
        same = F.col(source_col) == source if source is not None else ~F.coalesce(F.col(source_col).isin(*weights), F.lit(False))
        rate = F.when(same, F.lit(mean)).otherwise(rate)
        copies = F.when(same, poisson_count(mean, seed, F.col(id_col))).otherwise(copies)
    added = {name: _unused(df, f"_{name}") for name in ("rate", "copies", "copy", "shuffle_key")}
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(added["copy"]).cast("string")))
    repeated = (
        df.withColumns({added["rate"]: rate, added["copies"]: copies})
        .where(F.col(added["copies"]) > 0)
        .withColumn(added["copy"], F.explode(F.sequence(F.lit(0), F.col(added["copies"]) - 1)))
        .withColumn(added["shuffle_key"], key)
    )
    return repeated.repartition(added["shuffle_key"]).sortWithinPartitions(added["shuffle_key"]), added
