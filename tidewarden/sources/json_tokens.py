"""JSON texts as arrays of tokens with their paths, and rewrites of their text leaves.

One regex cuts a text into tokens and one fold gives each its path, so a rewrite is
an expression of one scan, in the JVM, for JSON of any shape and depth. Tokens that
aren't changed are put back as they were: types, order, numbers and white space stay.

A path is ``$``, then ``.key`` or ``[index]`` for each level; a key that is no plain
word is ``["key"]`` as it stands in the text, so paths of different leaves differ.
Texts that are no JSON (also those that repeat a key in one object) have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'(?s){_STRING}(?:\s*+:)?+|[\[\]{{}},]|[^\[\]{{}},"]++'
_ARRAY_AT = r"^\[\d"
_STATE = "struct<stack:array<string>,out:array<struct<path:string,kind:string,token:string>>>"
#: Tokens of a block, and of a block inside it: a fold copies what it has gathered, so each gathers little.
_BLOCKS = (4096, 64)


def is_json(text: Column) -> Column:
    """Whether a text is JSON; null is not."""
    return F.try_parse_json(text).isNotNull()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _up(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _is_key(t: Column) -> Column:
    return t.startswith('"') & t.endswith(":")


def _moved(stack: Column, t: Column) -> Column:
    """The stack of path parts behind a token."""
    top = F.try_element_at(stack, F.lit(-1))
    place = F.regexp_extract(top, r"^\[(\d+)", 1).cast("int") + 1
    word = F.regexp_extract(t, r'^"([A-Za-z_][A-Za-z0-9_-]*+)"', 1)
    part = F.when(word != "", F.concat(F.lit("."), word)).otherwise(F.concat(F.lit("["), F.regexp_replace(t, r"\s*:$", ""), F.lit("]")))
    return (
        F.when(_is_key(t), F.concat(_up(stack), F.array(part)))
        .when(t == "{", F.concat(stack, F.array(F.lit("."))))
        .when(t == "[", F.concat(stack, F.array(F.lit("[0]"))))
        .when(t.isin("}", "]"), _up(stack))
        .when((t == ",") & top.rlike(_ARRAY_AT), F.concat(_up(stack), F.array(F.concat(F.lit("["), place.cast("string"), F.lit("]")))))
        .otherwise(stack)
    )


def _kind(t: Column) -> Column:
    return F.when(t.startswith('"'), F.when(t.endswith(":"), "key").otherwise("text")).when(t.isin("{", "}", "[", "]", ",") | ~t.rlike(r"\S"), "").otherwise("value")


def json_tokens(text: Column) -> Column:
    """Array of ``path, kind, token``; kinds are ``text``, ``value`` (other leaves), ``key`` and empty. Null where the text is no JSON."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def step(s: Column, t: Column) -> Column:
        def placed(stack: Column) -> Column:
            here = F.struct(F.concat(F.lit("$"), F.array_join(stack, "")).alias("path"), _kind(t).alias("kind"), t.alias("token"))
            return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(here)).alias("out"))

        return once(_moved(s["stack"], t), placed)

    def empty(stack: Column) -> Column:
        return F.struct(stack.alias("stack"), F.array().alias("out")).cast(_STATE)

    def fold(tokens: Column, stack: Column, blocks: tuple[int, ...]) -> Column:
        if not blocks:
            return F.aggregate(tokens, empty(stack), step)

        def block(s: Column, i: Column) -> Column:
            part = once(F.slice(tokens, i * blocks[0] + 1, F.lit(blocks[0])), lambda own: fold(own, s["stack"], blocks[1:]))
            return once(part, lambda r: F.struct(r["stack"].alias("stack"), F.concat(s["out"], r["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(tokens) / blocks[0]).cast("int")), empty(stack), block)

    return F.when(is_json(text), once(found, lambda t: fold(t, F.array().cast("array<string>"), _BLOCKS)["out"]))


def unescaped(token: Column) -> Column:
    """The text of a string token."""
    parsed = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(token.contains("\\"), parsed).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def escaped(text: Column) -> Column:
    """A text as a string token."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def joined(tokens: Column) -> Column:
    """Tokens put together."""
    return F.array_join(F.transform(tokens, lambda t: t["token"]), "")


def with_texts(tokens: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The JSON whose text leaves are ``change(path, text)``; a null keeps the leaf."""

    def leaf(t: Column) -> Column:
        def new(x: Column) -> Column:
            return once(change(t["path"], x), lambda y: F.when(y.isNull() | (y == x), t["token"]).otherwise(escaped(y)))

        return F.when(t["kind"] == "text", once(unescaped(t["token"]), new)).otherwise(t["token"])

    return F.array_join(F.transform(tokens, leaf), "")


def rewritten(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """As ``with_texts`` for a JSON text; null where it is no JSON."""
    return once(json_tokens(text), lambda t: with_texts(t, change))


def field_of(path: Column) -> Column:
    """The nearest key of a path, in lower case."""
    return F.lower(F.regexp_extract(path, r'(?:\.([^.\[\]"]+)|\["[^"]*"\])(?:\[\d+\])*$', 1))


def leaves(df: DataFrame, id_cols: list[str], json_col: str) -> DataFrame:
    """All leaves but nulls: ids, ``path, kind, text``; a text that is no JSON is one leaf ``$``. Rows of null have none."""
    whole = F.array(F.struct(F.lit("$").alias("path"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("token")))
    listed = F.filter(F.coalesce(json_tokens(F.col(json_col)), whole), lambda t: t["kind"].isin("text", "value") & ~F.coalesce(t["token"], F.lit("")).rlike(r"^\s*null\s*$"))
    rows = df.where(F.col(json_col).isNotNull()).select(*id_cols, F.col(json_col).alias("_whole"), F.explode_outer(listed).alias("_t")).where("_t is not null")
    text = F.when(F.col("_t.token").isNull(), F.col("_whole")).when(F.col("_t.kind") == "text", unescaped(F.col("_t.token"))).otherwise(F.regexp_replace("_t.token", r"^\s+|\s+$", ""))
    return rows.select(*id_cols, "_t.path", "_t.kind", text.alias("text"))


def slimmed(text: Column, dropped: str = "parameters", emptied: str = "tools") -> Column:
    """JSON without the members named ``dropped``, those named ``emptied`` as empty lists, at any depth; null where it is no JSON."""
    under, below, at = rf"\.{dropped}(?:[.\[]|$)", rf"\.{emptied}[.\[]", rf"\.{emptied}$"

    def one(t: Column) -> Column:
        inside = t["path"].rlike(under) | t["path"].rlike(below)
        return F.when(inside, "").when(t["path"].rlike(at), F.when(t["kind"] == "key", F.concat(t["token"], F.lit("[]"))).when(t["token"] == ",", ",").otherwise("")).otherwise(t["token"])

    kept = once(json_tokens(text), lambda tokens: F.array_join(F.transform(tokens, one), ""))
    return F.regexp_replace(kept, rf"(?s)({_STRING})|,(?=\s*\}})", "$1")
