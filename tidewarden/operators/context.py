"""Identity of requests, registrations, retention and merged counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metadata keys of a conversation's id, in order.
CONVERSATION_KEYS = ["cursorConversationId", "conversationId", "conversation_id", "session_id"]
#: Parts of a textual content type.
TEXTUAL = ["json", "xml", "x-www-form-urlencoded", "javascript", "graphql"]
#: Stages whose replacements are redactions, and stages whose hits are dangerous.
REDACTION_STAGES = ["redaction", "exact_value_redaction"]
DANGER_STAGES = ["anomaly_detector", "injection_detector", "privilege_guard", "tool_call_guard", "rag_poison_guard", "untrusted_content_guard", "output_sanitizer", "post_restore_guard"]
#: Least age of a mapping before it may go, usual age, least characters of a sensitive value.
LEAST_AGE, AGE, LEAST_VALUE = 300, 86_400, 10


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def session_id(client: Column, request_id: Column, hint: Column) -> Column:
    """The client's session or the request, within its token."""
    own = F.coalesce(_filled(client), request_id)
    return F.coalesce(F.concat(_filled(F.trim(hint)), F.lit(":"), own), own)


def tenant_id(bound: Column, hint: Column) -> Column:
    return F.coalesce(_filled(F.trim(bound)), F.concat(F.lit("token:"), _filled(hint)), F.lit("default"))


def conversation_id(payload: Column) -> Column:
    """The first metadata key that holds a text; null if none does."""
    kinds = F.from_json(F.get_json_object(payload, "$.metadata"), "map<string,string>")
    quoted = lambda k: F.get_json_object(payload, "$.metadata").rlike(rf'"{k}"\s*:\s*"')
    return F.coalesce(*[F.when(quoted(k), _filled(kinds[k])) for k in CONVERSATION_KEYS])


def textual(content_type: Column) -> Column:
    """Whether a content type is text."""
    low = F.lower(content_type)
    return low.startswith("text/") | low.rlike("|".join(TEXTUAL))


def sensitive_values(values: DataFrame, col: str) -> DataFrame:
    """Trimmed distinct values that are long enough to be replaced."""
    return values.select(F.trim(col).alias(col)).where(F.length(col) >= LEAST_VALUE).distinct()


def upstream(address: Column) -> Column:
    return F.regexp_replace(F.trim(address), "/+$", "")


def registered(tokens: DataFrame) -> DataFrame:
    """The first token (by ``seq``) of each upstream: ``upstream, token``."""
    t = tokens.withColumn("upstream", upstream(F.col("upstream"))).where("upstream <> ''")
    return t.groupBy("upstream").agg(F.min_by("token", "seq").alias("token"))


def kept_mappings(mappings: DataFrame, as_of: Column, age: int = AGE) -> DataFrame:
    """Mappings that are younger than ``age`` (LEAST_AGE at least) or without a time."""
    cut = as_of - F.make_interval(secs=F.lit(max(LEAST_AGE, age)))
    return mappings.where(F.col("created_at").isNull() | (F.col("created_at") >= cut))


def kept_pending(pending: DataFrame, as_of: Column) -> DataFrame:
    return pending.where(F.col("retained_until") > as_of)


def kept_days(df: DataFrame, day: Column, as_of: Column, days: int = 10) -> DataFrame:
    """Rows of the last ``days`` days, ``as_of`` included."""
    return df.where(day > F.date_sub(as_of, days))


def merged_counters(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Snapshots of counters added up; a counter that a snapshot lacks is 0 there."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole.columns if c not in by])


def stage_totals(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """Redactions and dangerous hits of reports (``stage, hit, replacements``)."""
    redactions = F.sum(F.when(F.col("stage").isin(REDACTION_STAGES), F.col("replacements")).otherwise(F.lit(0)))
    return reports.groupBy(*by).agg(redactions.alias("redactions"), F.count_if(F.col("stage").isin(DANGER_STAGES) & F.col("hit")).alias("dangerous"))
