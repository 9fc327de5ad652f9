"""Decisions from tags, reasons and classifier confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that stop a stream whatever the risk, in the order in which they are named.
HIGH_RISK_TAGS = ["response_injection_system_exfil", "response_injection_unicode_bidi", "response_privilege_abuse", "response_semantic_leak", "response_semantic_privilege"]
#: Short texts for reasons.
REASON_TEXTS = {
    "response_high_risk_command": "A command with high risk was found in the output.",
    "response_blocked": "The output was blocked.",
    "response_sanitized": "Parts of the output were replaced.",
    "response_tool_call_violation": "A tool call broke the rules.",
    "response_human_review_required": "The output needs a review.",
    "response_high_risk": "The risk score is over the limit.",
}
#: Confidence gates and factors of the blend.
SAFE_GATE, INJECTION_GATE, DAMP_GATE = 0.88, 0.85, 0.70
CLASS_RISK = {"injection": 0.76, "leaking": 0.90, "privileged": 0.86}
SEVERAL, DISCUSSED, DAMPED = 0.06, 0.72, 0.75


def block_reason(tags: Column, actions: Column, disposition: Column, last_reason: Column, review: Column, risk: Column, threshold: float = 0.85) -> Column:
    """Why a stream has to stop, or null; the first rule that holds decides."""
    named = F.when(F.array_contains(tags, "response_anomaly_high_risk_command"), "response_high_risk_command")
    named = named.when(disposition == "block", F.coalesce(last_reason, F.lit("response_blocked"))).when(disposition == "sanitize", "response_sanitized")
    blocked = F.exists(actions, lambda a: a.startswith("tool_call_guard:") & a.endswith(":block"))
    named = named.when(F.array_contains(tags, "tool_call_violation") & blocked, "response_tool_call_violation")
    named = named.when(review & F.exists(tags, lambda t: t.startswith("response_")), "response_human_review_required")
    for tag in HIGH_RISK_TAGS:
        named = named.when(F.array_contains(tags, tag), tag)
    return named.when(risk >= max(threshold, 0.9), "response_high_risk")


def reason_text(reason: Column) -> Column:
    held = F.create_map(*[F.lit(x) for pair in REASON_TEXTS.items() for x in pair])
    return F.coalesce(F.try_element_at(held, reason), reason)


def blended_risk(flags: dict[str, Column], discussion: Column, label: Column, confidence: Column) -> Column:
    """Risk from classes of rules and a classifier (``label`` safe, injection or unknown)."""
    sure = (label == "injection") & (confidence >= INJECTION_GATE)
    risk = F.when(sure, 0.55 + (confidence - INJECTION_GATE) * 2.0).otherwise(F.lit(0.0))
    count = sure.cast("int")
    for name, value in CLASS_RISK.items():
        risk = F.when(flags[name], F.greatest(risk, F.lit(value))).otherwise(risk)
        count = count + flags[name].cast("int")
    risk = F.when(count >= 2, F.least(F.lit(1.0), risk + SEVERAL)).otherwise(risk)
    risk = F.when((count > 0) & discussion, risk * DISCUSSED).otherwise(risk)
    risk = F.when((label == "safe") & (confidence >= DAMP_GATE), risk * DAMPED).otherwise(risk)
    return F.when((label == "safe") & (confidence >= SAFE_GATE), F.lit(0.0)).otherwise(F.round(risk, 6))


def escalated(df: DataFrame, id_col: str, scored: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Rows in the gray zone get the larger of their risk and the second score (``semantic``) joined to them."""
    gray = (F.col("risk") > low) & (F.col("risk") < high)
    # the zone is part of the join's condition: as a filter it would run the first score once more
    second = scored.select(F.col(id_col).alias("_id"), "semantic")
    return df.join(second, (F.col(id_col) == F.col("_id")) & gray, "left").withColumn("risk", F.greatest("risk", F.coalesce("semantic", F.lit(0.0)))).drop("semantic", "_id")
