"""Redaction and cleaning inside JSON texts, with the shape kept.

All are column expressions over the tokens of a JSON text (see ``json_tokens``):
one scan, no shuffle, in the JVM, with the regexes of the scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed
from tidewarden.operators import scan
from tidewarden.operators.scan import Rule
from tidewarden.sources import json_tokens as jt

#: Field names whose values are never redacted (fixed values).
KEPT_FIELDS = frozenset(["id", "call_id", "item_id", "message_id", "request_id", "response_id", "signature", "encrypted_content", "previous_response_id"])
#: Paths of calls, items and texts in response bodies.
_CALL = r"^(\$\.choices\[\d+\]\.message\.tool_calls\[\d+\]\.function)\.(?:name|arguments)$"
_ITEM, _PART = r"^(\$\.output\[\d+\])", r"^(\$\.output\[\d+\]\.content\[\d+\])"
_ABOUT = rf"{_CALL}|^\$\.output\[\d+\]\.(?:type|name|arguments|content\[\d+\]\.text)$"
_TEXTS = r"^\$\.choices\[\d+\]\.message\.content(?:[.\[]|$)|^\$\.output_text$|^\$\.content$|^\$\.content\[\d+\](?:\.text)?$"


def _any_hit(text: Column, rules: Sequence[Rule]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(r.java) for r in rules], F.lit(False)), F.lit(False))


def _marked(text: Column, rules: Sequence[Rule], mark: str | None = None) -> Column:
    """All matches replaced, rule by rule, by ``mark`` or ``[REDACTED:ID]``."""
    for r in rules:
        text = F.regexp_replace(text, r.java, mark or f"[REDACTED:{r.rule_id}]")
    return text


def _texts_at(tokens: Column, paths: str) -> Column:
    """Map of the text leaves whose path matches."""
    found = F.filter(tokens, lambda t: (t["kind"] == "text") & t["path"].rlike(paths))
    return F.map_from_entries(F.transform(found, lambda t: F.struct(t["path"], jt.unescaped(t["token"]))))


def kept_field(path: Column, kept: frozenset[str] = KEPT_FIELDS) -> Column:
    """Whether the field is an identity or an encrypted value, which is never redacted."""
    field = jt.field_of(path)
    return reduce(lambda a, end: a | field.endswith(end), fixed.CIPHER_ENDS, field.isin(*kept, *fixed.IDENTITY_FIELDS, *fixed.CIPHER_FIELDS))


def media_locator(path: Column, types: Column) -> Column:
    """Whether a leaf locates media: it is scanned, and never changed. ``types`` maps paths to block types."""
    field = jt.field_of(path)
    block = F.lower(F.trim(F.try_element_at(types, F.concat(F.regexp_extract(path, r"^(.*)\.source\.(?:url|uri)$", 1), F.lit(".type")))))
    source = path.rlike(r"\.source\.(?:url|uri)$") & F.coalesce(block.isin(*fixed.MEDIA_BLOCKS), F.lit(False))
    return field.isin(*fixed.MEDIA_FIELDS) | (field.isin(*fixed.MEDIA_URL_FIELDS) & (path.contains(".image_url.") | source))


def redact_json(column: Column, rules: Sequence[Rule], kept: frozenset[str] = KEPT_FIELDS) -> Column:
    """The JSON with secrets in its text leaves marked; text that is no JSON is null.

    Identities, encrypted values and locators of media stay as they are.
    """

    def change(types: Column):
        return lambda path, x: F.when(~kept_field(path, kept) & ~media_locator(path, types), _marked(x, rules))

    return jt.once(jt.json_tokens(column), lambda t: jt.once(_texts_at(t, r"\.type$"), lambda types: jt.with_texts(t, change(types))))


def json_hits(df: DataFrame, id_cols: Sequence[str], json_col: str, rules: Sequence[Rule], kept: frozenset[str] = KEPT_FIELDS) -> DataFrame:
    """Hits by leaf: ids, ``path, field, rule_group, rule_id, n``; locators of media are scanned too, kept fields aren't."""
    rows = jt.leaves(df, list(id_cols), json_col).where("kind = 'text'").where(~kept_field(F.col("path"), kept))
    return scan.findings(rows, "text", rules, [*id_cols, "path"]).withColumn("field", jt.field_of(F.col("path")))


def _clean_arguments(text: Column, rules: Sequence[Rule], mark: str) -> Column:
    """Arguments of a call cleaned as a whole, or leaf by leaf where that would break their JSON."""

    def chosen(y: Column) -> Column:
        broken = (y != text) & jt.is_json(text) & ~jt.is_json(y)
        return F.when(broken, jt.rewritten(text, lambda _, x: _marked(x, rules, mark))).otherwise(y)

    return jt.once(_marked(text, rules, mark), chosen)


def clean_body(body: Column, rules: Sequence[Rule], danger: Sequence[Rule], mark: str, placeholder: str) -> Column:
    """A response body of three vendor shapes, cleaned in place; null where it is no JSON.

    Texts of messages, outputs and content blocks have matches of ``rules``
    replaced by ``mark``. A tool call whose name and arguments any of ``danger``
    hits gets ``placeholder`` as its name and arguments that only say so; of a shell
    or computer action all texts become the placeholder. Items of other types stay.
    """
    blocked = f'{{"_blocked": "{placeholder}"}}'

    def actions(tokens: Column) -> Column:
        """Map of items to all texts of their action."""
        items = F.filter(tokens, lambda t: (t["kind"] == "text") & t["path"].rlike(r"^\$\.output\[\d+\]\.type$") & F.lower(F.trim(jt.unescaped(t["token"]))).isin("bash", "computer_call"))

        def entry(t: Column) -> Column:
            item = F.regexp_extract(t["path"], _ITEM, 1)
            own = F.filter(tokens, lambda u: (u["kind"] == "text") & u["path"].startswith(F.concat(item, F.lit(".action"))))
            return F.struct(item, F.array_join(F.transform(own, lambda u: jt.unescaped(u["token"])), " "))

        return F.map_from_entries(F.transform(items, entry))

    def change(about: Column, acts: Column):
        def one(path: Column, x: Column) -> Column:
            call, item = F.regexp_extract(path, _CALL, 1), F.regexp_extract(path, _ITEM, 1)
            kind = F.coalesce(F.lower(F.trim(F.try_element_at(about, F.concat(item, F.lit(".type"))))), F.lit(""))
            rest = F.substring(path, F.length(item) + 1, F.length(path))
            owner = F.when(call != "", call).when((kind == "function_call") & rest.isin(".name", ".arguments"), item)
            said = F.concat_ws(" ", F.try_element_at(about, F.concat(owner, F.lit(".name"))), F.try_element_at(about, F.concat(owner, F.lit(".arguments"))))
            bad, name = _any_hit(said, danger), path.endswith(".name")
            called = F.when(bad, F.when(name, placeholder).otherwise(F.lit(blocked))).otherwise(F.when(name, _marked(x, rules, mark)).otherwise(_clean_arguments(x, rules, mark)))
            whole_part = F.try_element_at(about, F.concat(F.regexp_extract(path, _PART, 1), F.lit(".text"))).isNull()
            spoken = (kind == "message") & (path.rlike(_PART + r"\.text$") | (rest.startswith(".content[") & whole_part))
            plain = path.rlike(_TEXTS) | spoken | ((item != "") & (kind == "") & rest.isin(".text", ".summary", ".output_text"))
            acted = kind.isin("bash", "computer_call") & rest.rlike(r"^\.action(?:[.\[]|$)")
            return (
                F.when(owner.isNotNull(), called)
                .when(acted, F.when(_any_hit(F.try_element_at(acts, item), danger), F.lit(placeholder)).otherwise(_marked(x, rules, mark)))
                .when(plain, _marked(x, rules, mark))
            )

        return one

    def with_maps(t: Column) -> Column:
        return jt.once(F.struct(_texts_at(t, _ABOUT).alias("about"), actions(t).alias("acts")), lambda m: jt.with_texts(t, change(m["about"], m["acts"])))

    return jt.once(jt.json_tokens(body), with_maps)


def gated_rules(rules: Sequence[Rule], obvious_only: bool = False) -> list[Rule]:
    """Rules that responses are cleaned by: all, or those of message framing only."""
    framing = {i for i, _ in fixed.HTTP_FRAMING}
    return [r for r in rules if not obvious_only or r.rule_id in framing]


def _replaced_if(gate: Column, rule: Rule, mark: str, text: Column) -> Column:
    return F.when(gate, F.regexp_replace(text, rule.java, mark)).otherwise(text)


def clean_response_text(text: Column, rules: Sequence[Rule], mark: str) -> Column:
    """Matches replaced by ``mark``; rules of scripts count only where a sure shape occurs, and of the rules that hit the first MOST_RESPONSE_RULES."""
    sure = _any_hit(text, [Rule("sure", str(i), p) for i, p in enumerate(fixed.SURE_SCRIPTS)])

    def cleaned(is_sure: Column) -> Column:
        out, used = text, F.lit(0)
        for k, r in enumerate(rules):
            gate = is_sure if any(h in r.rule_id.lower() for h in fixed.SCRIPT_HINTS) else None
            if k >= fixed.MOST_RESPONSE_RULES:
                left = used < fixed.MOST_RESPONSE_RULES
                gate = left if gate is None else gate & left
            if len(rules) > fixed.MOST_RESPONSE_RULES:
                used = used + F.coalesce(text.rlike(r.java).cast("int"), F.lit(0))
            out = F.regexp_replace(out, r.java, mark) if gate is None else jt.once(out, partial(_replaced_if, gate, r, mark))
        return out

    return jt.once(sure, cleaned)


def clean_response(body: Column, textual: Column, rules: Sequence[Rule], mark: str) -> Column:
    """A response body of any textual kind: JSON leaf by leaf, other text as a whole; bodies that aren't ``textual`` stay."""
    own = F.coalesce(jt.rewritten(body, lambda _, x: clean_response_text(x, rules, mark)), clean_response_text(body, rules, mark))
    return F.when(textual, own).otherwise(body)


def shapes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, shape``: digest of all leaf paths in order."""
    leaves = jt.leaves(df, [id_col], json_col)
    return leaves.groupBy(id_col).agg(F.md5(F.array_join(F.array_sort(F.collect_list("path")), "|")).alias("shape"))


def text_chunks(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text as ``chunk, start, text``."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - overlap) / step).cast("int"), F.lit(1))
    rows = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk") * step
    return rows.select(id_col, "chunk", start.alias("start"), F.substring(F.col(text_col), start + 1, F.lit(size)).alias("text"))
