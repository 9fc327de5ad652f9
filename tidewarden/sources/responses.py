"""Texts of response bodies by vendor shape, with safe fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.operators.scan import Rule

_CALLS = "array<struct<function:struct<name:string,arguments:string>>>"
#: Calls that are summed up, characters of their arguments, characters of an error.
CALLS, ARGUMENTS, ERROR = 5, 200, 300


def flat_text(body: Column, path: str) -> Column:
    """Text at a path: a string as it is, a list as the joined texts of its items; null where empty."""
    value = F.get_json_object(body, path)
    listed = F.array_join(F.transform(F.from_json(value, "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    text = F.when(F.get_json_object(body, f"{path}[0]").isNotNull(), listed).otherwise(value)
    return F.when(text != "", text)


def call_summary(body: Column, rules: Sequence[Rule], notice: str) -> Column:
    """The first calls of a chat answer as marks; calls that a rule hits only as ``notice``."""
    calls = F.slice(F.from_json(F.get_json_object(body, "$.choices[0].message.tool_calls"), _CALLS), 1, CALLS)

    def one(c: Column) -> Column:
        name, args = F.coalesce(c["function"]["name"], F.lit("?")), F.substring(F.coalesce(c["function"]["arguments"], F.lit("")), 1, ARGUMENTS)
        said = F.concat_ws(" ", name, args)
        bad = F.lit(False)
        for r in rules:
            bad = bad | said.rlike(r.java)
        return F.concat(F.lit("[tool_call:"), F.when(bad, F.lit(notice)).otherwise(F.concat(name, F.lit("("), args, F.lit(")"))), F.lit("]"))

    return F.when(F.size(calls) > 0, F.array_join(F.transform(calls, one), " "))


def chat_output_text(body: Column, rules: Sequence[Rule], notice: str) -> Column:
    """Text of a chat answer; else its calls, finish reason, other text fields or error, never the whole body."""
    finish = F.get_json_object(body, "$.choices[0].finish_reason")
    error = F.substring(F.get_json_object(body, "$.error"), 1, ERROR)
    return F.coalesce(
        flat_text(body, "$.choices[0].message.content"),
        call_summary(body, rules, notice),
        F.when(finish != "", F.concat(F.lit("[finish_reason="), finish, F.lit("]"))),
        *[flat_text(body, f"$.{k}") for k in ("output_text", "text", "output")],
        F.concat(F.lit("[error="), error, F.lit("]")),
        F.lit("[no_text_content]"),
    )


#: The fields of a body, and of an item, that may hold its text, in order.
OUTPUT_FIELDS = ["output_text", "output", "text", "choices"]
ITEM_FIELDS = ["content", "message", "output", "choices", "summary"]


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _at(v: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def _item_text(v: Column, levels: int) -> Column:
    """Text of one item: a string, the text of an object, or the summary of a call or an action."""
    kind = F.coalesce(_at(v, "type", "string"), F.lit(""))
    arguments = F.substring(F.coalesce(_at(v, "arguments", "string"), F.lit("")), 1, ARGUMENTS)
    call = F.concat(F.lit("[function_call:"), F.coalesce(_at(v, "name", "string"), F.lit("?")), F.lit("("), arguments, F.lit(")]"))
    action = F.concat(F.lit("["), kind, F.lit(":"), F.substring(F.coalesce(F.to_json(_at(v, "action")), F.lit("{}")), 1, ARGUMENTS), F.lit("]"))
    deeper = _first_text(v, ITEM_FIELDS, levels - 1) if levels > 1 else F.lit("")
    return (
        F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        .when(_kind(v) != "OBJECT", "")
        .when(_kind(_at(v, "text")) == "STRING", _at(v, "text", "string"))
        .when(kind == "function_call", call)
        .when(kind.isin("computer_call", "bash"), action)
        .otherwise(F.coalesce(deeper, F.lit("")))
    )


def _first_text(v: Column, fields: Sequence[str], levels: int) -> Column:
    """The first text that isn't empty of an object's fields; a list is the joined texts of its items. Null where there is none.

    One expression for all fields, so a plan grows with ``levels``, not with the ways through the fields.
    """

    def text(x: Column) -> Column:
        items = F.when(_kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))
        return F.array_join(F.transform(items, lambda i: _item_text(i, levels)), "")

    return F.get(F.filter(F.transform(F.array(*[_at(v, k) for k in fields]), text), lambda t: t != ""), F.lit(0))


def responses_output_text(body: Column, levels: int = 3) -> Column:
    """Text of an answer with ``output`` items: its text fields flattened in order, else status and error, never the whole body.

    Objects are looked into ``levels`` deep (a message of a choice has three). A body
    that is no JSON object is its own text; null stays null. Actions and errors are
    compact JSON.
    """
    v = F.try_parse_json(body)
    status = F.coalesce(_at(v, "status", "string"), F.lit("unknown"))
    error = F.when(_kind(_at(v, "error")) != "VOID", F.to_json(_at(v, "error")))
    said = F.coalesce(
        _first_text(v, OUTPUT_FIELDS, levels),
        F.concat(F.lit("[status="), status, F.lit(" error="), F.substring(error, 1, ERROR), F.lit("]")),
        F.concat(F.lit("[status="), status, F.lit("]")),
    )
    return F.when(_kind(v) == "OBJECT", said).otherwise(body)
