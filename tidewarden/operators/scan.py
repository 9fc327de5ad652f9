"""Rule scans: which rules hit a text, how often and where.

Each rule is a column expression, so a scan of all rules is one projection and
no shuffle. The text is lowered once for all of them. Scans of tables try a
rule's regex only on texts that pass its gate (``gates``, derived from the
regex); a single expression (``rule_hit``) only on those that contain one of the
literals that every match must contain (``anchors``).

Regexes run with ``.`` and ``$`` taking only ``\\n`` as a line end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _parser as parser  # the standard library's own regex parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed
from tidewarden.functions.session import small_batches
from tidewarden.operators import gates


@dataclass(frozen=True)
class Rule:
    """One detection rule."""

    group: str
    rule_id: str
    regex: str
    case_sensitive: bool = False

    @property
    def java(self) -> str:
        return f"(?d{'' if self.case_sensitive else 'i'}){self.regex}"


#: Shortest value that a field secret has, a fixed value.
FIELD_VALUE_MIN = 12
_VALUE = rf"[A-Za-z0-9._~+/=-]{{{FIELD_VALUE_MIN},}}"
_FIELDS = "api[_-]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret|private[_-]?key|secret(?:_key)?"
FIELD_SECRETS = [
    ("FIELD_SECRET", rf"\b(?:{_FIELDS})\b\s*[:=]\s*(?:bearer\s+)?{_VALUE}"),
    ("AUTH_BEARER", rf"\bauthorization\b\s*:\s*bearer\s+{_VALUE}"),
]
#: Groups whose regexes heed case.
CASE_SENSITIVE = {"pii", "dangerous_parameters", "parameter_shapes"}
#: Personal-data rules that are sure enough for model routes.
RELAXED = ["TOKEN", "JWT", "URL_TOKEN_QUERY", "PRIVATE_KEY_PEM", "AWS_ACCESS_KEY", "AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN", "SLACK_TOKEN", "EXCHANGE_API_SECRET", "CRYPTO_WIF_KEY", "CRYPTO_XPRV", "CRYPTO_SEED_PHRASE"]

_TABLES: dict[str, list[tuple[str, str]]] = {
    "pii": fixed.PII, "field_secrets": FIELD_SECRETS, "exfiltration": fixed.EXFILTRATION, "untrusted": fixed.UNTRUSTED, "direct": fixed.DIRECT,
    "system_exfil": fixed.SYSTEM_EXFIL, "html_markdown": fixed.HTML_MARKDOWN, "remote_content": fixed.REMOTE_CONTENT, "indirect_injection": fixed.INDIRECT,
    "remote_content_instruction": fixed.REMOTE_INSTRUCTION, "tool_call_injection": fixed.TOOL_FORGERY, "spam_noise": fixed.SPAM,
    "discussion_injection": fixed.DISCUSSION_INJECTION, "quoted": fixed.QUOTED, "rag_ingestion": fixed.RAG_INGESTION, "rag_retrieval": fixed.RAG_RETRIEVAL,
    "rag_propagation": fixed.RAG_PROPAGATION, "discussion_privilege": fixed.DISCUSSION_PRIVILEGE, "privilege": fixed.PRIVILEGE,
    "commands": fixed.COMMANDS + fixed.HTTP_FRAMING, "http_framing": fixed.HTTP_FRAMING, "discussion_request": fixed.DISCUSSION_REQUEST,
    "strong_intent": fixed.STRONG_INTENT, "leak": fixed.LEAK, "shape": fixed.SHAPE, "web_commands": fixed.WEB_COMMANDS, "encoded": fixed.ENCODED,
    "system_leak": fixed.SYSTEM_LEAK, "markup": fixed.MARKUP, "uri": fixed.URI, "parameter_shapes": fixed.PARAMETER_SHAPES,
    "dangerous_parameters": fixed.DANGEROUS_PARAMETERS, "semantic_approval": fixed.SEMANTIC_APPROVAL, "lures": fixed.LURES,
    "restored_secrets": [r for r in fixed.LEAK if r[0] in fixed.RESTORED_SECRETS],
    "relaxed_pii": [r for r in fixed.PII if r[0] in RELAXED],
}


def default_rules(*groups: str) -> list[Rule]:
    """The rules of the named groups (all where none is named)."""
    return [Rule(g, i, x, g in CASE_SENSITIVE or g == "relaxed_pii") for g in groups or _TABLES for i, x in _TABLES[g]]


def group_names() -> list[str]:
    return list(_TABLES)


# ---- literals that every match contains --------------------------------------

_MOST = 40


def _weight(literal: str) -> int:
    """How selective a literal is: its length, more for signs and ideographs; 0 where it is no use."""
    signs = sum(not c.isalnum() or ord(c) >= 0x3000 for c in literal)
    return len(literal) + 2 * signs if signs or len(literal) >= 3 else 0


def _literals(tree) -> list[str] | None:
    """Lower-case literals of which every match contains one, or None."""
    best: list[str] | None = None
    run = ""

    def better(found: list[str] | None) -> None:
        nonlocal best
        if found and len(found) <= _MOST and min(map(_weight, found)) > (0 if best is None else min(map(_weight, best))):
            best = found

    for op, value in tree:
        if str(op) == "LITERAL" and (value < 128 or value >= 0x3000):
            run += chr(value).lower()
            continue
        better([run] if run else None)
        run = ""
        name = str(op)
        if name == "SUBPATTERN":
            better(_literals(value[3]))
        elif name == "BRANCH":
            parts = [_literals(x) for x in value[1]]
            better([y for x in parts for y in x] if all(parts) else None)
        elif name == "IN" and all(str(o) == "LITERAL" and v < 128 and not chr(v).isspace() for o, v in value):
            better([chr(v).lower() for _, v in value])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            better(_literals(value[2]))
    better([run] if run else None)
    return best


@lru_cache(maxsize=None)
def anchors(regex: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of ``regex`` contains one; empty where none are known."""
    return tuple(sorted(set(_literals(parser.parse(regex)) or ())))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rule_hit(text: Column, lowered: Column, rule: Rule) -> Column:
    """Whether the rule hits."""
    hit = text.rlike(rule.java)
    found = anchors(rule.regex)
    return _any(lowered.contains(a) for a in found) & hit if found else hit


def group_hit(text: Column, lowered: Column, rules: Sequence[Rule]) -> Column:
    """Whether any rule hits; null texts are no hit."""
    return F.coalesce(_any(rule_hit(text, lowered, r) for r in rules), F.lit(False))


def with_lowered(df: DataFrame, text_col: str, name: str = "_lower") -> DataFrame:
    return df.withColumn(name, F.lower(F.col(text_col)))


def with_gates(df: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_lower`` and ``_gates``: for each rule, whether the text passes its gate. Arrow, no shuffle."""
    small_batches(df.sparkSession)
    return with_lowered(df, text_col).withColumn("_gates", gates.passed(F.col("_lower"), [r.regex for r in rules]))


def gated_hit(text: Column, rule: Rule, at: int) -> Column:
    """Whether the rule hits, of a row with ``_gates`` in which the rule has place ``at``."""
    return F.col("_gates")[at] & (text.rlike(rule.java) if gates.gate(rule.regex) else rule_hit(text, F.col("_lower"), rule))


def scan(df: DataFrame, text_col: str, rules: Sequence[Rule], out_col: str = "hits") -> DataFrame:
    """Add an array of ``rule_group, rule_id, n`` for the rules that hit."""
    text = F.col(text_col)
    found = [
        F.when(gated_hit(text, r, i), F.struct(F.lit(r.group).alias("rule_group"), F.lit(r.rule_id).alias("rule_id"), F.regexp_count(text, F.lit(r.java)).cast("long").alias("n")))
        for i, r in enumerate(rules)
    ]
    return with_gates(df, text_col, rules).withColumn(out_col, F.filter(F.array(*found), lambda x: x.isNotNull())).drop("_lower", "_gates")


def findings(df: DataFrame, text_col: str, rules: Sequence[Rule], id_cols: Sequence[str]) -> DataFrame:
    """One row for each row and rule that hits: ids, ``rule_group, rule_id, n``.

    With a plain explode, Spark infers a filter on the array's size and pushes it
    below the projections: every rule would run twice, each on its own lowered
    copy of the text. The outer form keeps one projection; rows without hits are
    dropped behind it.
    """
    hits = scan(df.select(*id_cols, text_col), text_col, rules)
    return hits.select(*id_cols, F.explode_outer("hits").alias("h")).where("h is not null").select(*id_cols, "h.*")


def group_flags(df: DataFrame, text_col: str, groups: dict[str, Sequence[Rule]]) -> DataFrame:
    """Add one boolean column for each group."""
    every = list(dict.fromkeys(r for rules in groups.values() for r in rules))
    flags = {name: F.coalesce(_any(gated_hit(F.col(text_col), r, every.index(r)) for r in rules), F.lit(False)) for name, rules in groups.items()}
    return with_gates(df, text_col, every).withColumns(flags).drop("_lower", "_gates")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with columns that later filters use but don't compute again.

    A filter is pushed below the projections, where every flag in it would run once
    more, each literal on its own lowered copy of the text; it isn't pushed below an
    explode of its columns (see ``findings``).
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def match_spans(text: Column, java_regex: str) -> Column:
    """All matches as an array of ``start`` (from 0), ``end``, ``value``.

    The positions follow from the lengths of the matches and of what lies between.
    """
    rx = F.lit(java_regex)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    between = F.split(text, java_regex, -1)

    def span(value: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(found, span)


#: Characters on each side of a hit that its context shows, a fixed value.
CONTEXT = 40


def hit_context(text: Column, java_regex: str, characters: int = CONTEXT) -> Column:
    """Each match with what stands around it, trimmed; ``…`` where the text goes on. Null texts have none."""

    def segment(s: Column) -> Column:
        left, right = F.greatest(s["start"] - characters, F.lit(0)), F.least(s["end"] + characters, F.length(text))
        shown = F.concat(F.when(left > 0, "…").otherwise(""), F.substring(text, left + 1, right - left), F.when(right < F.length(text), "…").otherwise(""))
        return F.regexp_replace(shown, r"^\s+|\s+$", "")

    return F.transform(match_spans(text, java_regex), segment)


def merge_spans(spans: Column) -> Column:
    """Sorted spans (``start, end``) with those that touch or overlap joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(held) > 0) & (s["start"] <= F.try_element_at(held, F.lit(-1))["end"]), joined).otherwise(F.concat(held, F.array(s)))

    def add_safe(held: Column, s: Column) -> Column:
        return F.when(F.size(held) == 0, F.array(s)).otherwise(add(held, s))

    return F.aggregate(plain, empty, add_safe)


def to_re2(rule: Rule) -> str:
    """The regex for engines with RE2 syntax."""
    flags = "" if rule.case_sensitive else "(?i)"
    return flags + re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", rule.regex)
