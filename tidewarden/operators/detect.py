"""Detectors that are more than a regex, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed

#: Scripts that are rare in ordinary messages.
RARE_SCRIPTS = ["Armenian", "Hebrew", "Thaana", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Lao", "Tibetan", "Myanmar", "Georgian", "Ethiopic", "Cherokee", "Khmer", "Mongolian"]
_PRINTABLE = "".join(map(chr, [*range(32, 127), 9, 10, 11, 12, 13]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: an expression inside a higher-order function runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def script_count(text: Column) -> Column:
    """Different rare scripts in a text: all lie behind U+024F, so what lies before is taken out once for all of them."""
    return bound(F.regexp_replace(text, r"[\x00-\x{024F}]+", ""), lambda rest: sum((rest.rlike(rf"\p{{Is{s}}}").cast("int") for s in RARE_SCRIPTS), F.lit(0)))


def mixed_script_words(text: Column) -> Column:
    """Words of four letters or more with letters of two rare scripts."""
    rare = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 4) & w.rlike(r"[^\x00-\x{024F}]"))
    return F.filter(rare, lambda w: script_count(w) >= 2)


def repetition_ratio(text: Column) -> Column:
    """Share of the most frequent character, white space left out."""

    def share(compact: Column) -> Column:
        times = F.transform(F.array_distinct(F.split(compact, "")), lambda c: F.when(c == "", 0).otherwise(F.length(compact) - F.length(F.replace(compact, c, F.lit("")))))
        return F.when(F.length(compact) > 0, F.array_max(times) / F.length(compact)).otherwise(F.lit(0.0))

    return bound(F.regexp_replace(text, r"\s+", ""), share)


def longest_run(text: Column) -> Column:
    """Longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1+"), F.lit(0)), F.length)), F.when(F.length(text) > 0, 1).otherwise(0))


def most_repeated_line(text: Column) -> Column:
    """How often the most frequent line with text occurs."""
    lines = F.array_sort(F.filter(F.transform(F.split(text, "\n", -1), F.trim), lambda x: x != ""))
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def count(a: Column, x: Column) -> Column:
        n = F.when(a["line"] == x, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("line"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(lines, start, count, lambda a: a["best"])


#: Tokens of a kind that queries decode whose SQL takes the first ones only.
FIRST_TOKENS = 8
#: What a text must contain for ``decoded_attack`` to find anything.
DECODABLE = "[A-Za-z0-9+/]{24}|[0-9a-fA-F]{32}|%[0-9A-Fa-f]{2}"
#: What a text must contain for ``typo_words`` to find anything.
TYPO_SHAPES = "(?i)" + "|".join(f"{w[0]}[{''.join(sorted(set(w[1:-1])))}]{{{len(w) - 2}}}{w[-1]}" for w in fixed.TYPO_TARGETS)


def decoded_base64(token: Column) -> Column:
    """Text of a base64 token, or null where it is none or mostly not printable."""
    well = (F.length(token) % 4 == 0) & token.rlike("^[A-Za-z0-9+/]+={0,2}$")
    plain = F.translate(F.make_valid_utf8(F.unbase64(F.when(well, token)).cast("string")), chr(0xFFFD), "")
    shown = F.length(plain) - F.length(F.translate(plain, _PRINTABLE, ""))
    return F.when((F.length(plain) > 0) & (shown / F.length(plain) >= 0.8), plain)


def decoded_hex(token: Column) -> Column:
    """Text of a hex token of even length, or null."""
    plain = F.translate(F.make_valid_utf8(F.unhex(F.when(F.length(token) % 2 == 0, token)).cast("string")), chr(0xFFFD), "")
    return F.when(F.length(plain) > 0, plain)


def decoded_texts(text: Column, most: int | None = None, depth: int = 2) -> Column:
    """All texts that base64, hex and percent decoding of a text give, twice over; with ``most``, only of so many first tokens of a kind."""

    def tokens(t: Column, regex: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(regex), F.lit(0))
        return found if most is None else F.slice(found, 1, most)

    def once(t: Column) -> Column:
        b = F.transform(tokens(t, "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}={0,2}"), decoded_base64)
        h = F.transform(tokens(t, r"\b[0-9a-fA-F]{32,}\b"), decoded_hex)
        u = F.when(t.rlike("%[0-9A-Fa-f]{2}"), F.array(F.try_url_decode(F.regexp_replace(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")))).otherwise(F.array(F.lit(None).cast("string")))
        return F.array_compact(F.concat(b, h, u))

    found = once(text)
    for _ in range(depth - 1):
        found = bound(found, lambda held: F.concat(held, F.flatten(F.transform(held, once))))
    return F.array_distinct(found)


def decoded_attack(text: Column, most: int | None = None) -> Column:
    """Whether decoding shows one of the keywords."""
    return F.exists(decoded_texts(text, most), lambda t: F.lower(t).rlike("|".join(fixed.DECODED_KEYWORDS)))


def _typo_key(word: Column) -> Column:
    inner = F.array_join(F.array_sort(F.split(F.substring(word, F.lit(2), F.length(word) - 2), "")), "")
    return F.concat(F.substring(word, 1, 1), inner, F.right(word, F.lit(1)))


def _python_key(word: str) -> str:
    return word[0] + "".join(sorted(word[1:-1])) + word[-1]


def typo_words(text: Column) -> Column:
    """Words that are one of the targets with its inner letters in another order."""
    keys = {_python_key(w): w for w in fixed.TYPO_TARGETS}
    shaped = F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:{TYPO_SHAPES.removeprefix('(?i)')})\b"), F.lit(0))
    near = F.filter(F.array_distinct(shaped), lambda w: ~w.isin(*fixed.TYPO_TARGETS))
    return F.filter(near, lambda w: _typo_key(w).isin(*keys))


def obfuscated_marker(text: Column, dense: Column) -> Column:
    """Whether a marker occurs in the text or in its condensed form."""
    conditions = [text.contains(m) | dense.contains(m) for m in fixed.OBFUSCATED]
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def encoded_payloads(text: Column, base64: int = 200, hexadecimal: int = 300, percent: int = 12) -> dict[str, Column]:
    """Long encoded payloads by kind."""
    long64 = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{80,}={0,2}"), F.lit(0))
    return {
        "base64_payload": F.exists(long64, lambda t: (F.length(t) >= base64) & (F.length(t) % 4 == 0)),
        "hex_payload": text.rlike(rf"\b[0-9a-fA-F]{{{hexadecimal},}}\b"),
        "url_encoded_payload": F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}")) >= percent,
    }
