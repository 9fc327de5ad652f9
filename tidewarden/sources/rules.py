"""Rule packs as tables: reading, checking and overlaying them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.scan import Rule, default_rules

SCHEMA = "rule_group string, rule_id string, ord int, regex string, case_sensitive boolean"
#: Rules that a pack may have at most; a pack is read on the driver to build column expressions.
MOST_RULES = 10_000


def rules_table(spark: SparkSession, *groups: str) -> DataFrame:
    """The default rules as a table."""
    return spark.createDataFrame([(r.group, r.rule_id, i, r.regex, r.case_sensitive) for i, r in enumerate(default_rules(*groups))], SCHEMA)


def overlay(base: DataFrame, override: DataFrame) -> DataFrame:
    """Groups of the override replace the same groups of the base."""
    return base.join(override.select("rule_group").distinct(), "rule_group", "left_anti").unionByName(override)


def load_rules(table: DataFrame) -> tuple[list[Rule], list[tuple[str, str, str]]]:
    """Rules in order, and the rejects (group, id, reason) whose regex isn't valid."""
    rows = table.orderBy("rule_group", "ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a pack has more than {MOST_RULES} rules")
    good, bad = [], []
    for r in rows:
        try:
            re.compile(r["regex"])
        except re.error as e:
            bad.append((r["rule_group"], r["rule_id"], str(e)))
        else:
            good.append(Rule(r["rule_group"], r["rule_id"], r["regex"], bool(r["case_sensitive"])))
    return good, bad


def function_name(name):
    """Names with other characters than letters, digits, ``_`` and ``-`` replaced."""
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")
