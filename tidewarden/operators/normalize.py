"""Normal forms and other text preparation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewarden.functions import patterns as fixed

INVISIBLE = "".join(map(chr, fixed.INVISIBLE))
BIDI = "".join(map(chr, fixed.BIDI))
_LOOK_ALIKE = "".join(map(chr, fixed.CONFUSABLES))
_PLAIN = "".join(fixed.CONFUSABLES.values())
#: Code points that a compatibility normal form may change: a superset of them.
_MAY_CHANGE = "[" + "".join(map(chr, [0xA0, 0xA8, 0xAA, 0xAF])) + chr(0xB2) + "-" + chr(0xB5) + chr(0xB8) + "-" + chr(0xBA) + chr(0xBC) + "-" + chr(0xBE) + chr(0x0100) + "-" + chr(0x10FFFF) + "]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; only texts that may change go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(_MAY_CHANGE), text)), text)


def strip_hidden(text: Column) -> Column:
    """Without invisible and direction-changing code points."""
    return F.translate(text, INVISIBLE + BIDI, "")


def clean_form(text: Column) -> Column:
    """Compatibility form without hidden code points."""
    return strip_hidden(nfkc(text))


def detection_form(text: Column) -> Column:
    """Compatibility form, look-alikes replaced, hidden code points out, lower case, single blanks."""
    plain = F.translate(strip_hidden(F.translate(nfkc(text), _LOOK_ALIKE, _PLAIN)), "", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def condensed(text: Column) -> Column:
    """Without white space, punctuation and underscores."""
    return F.regexp_replace(text, r"(?U)[\s\W_]+", "")


def capped(text: Column, limit: int, mark: str = " [TRUNCATED]") -> Column:
    """Cut to ``limit`` characters, with a mark where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def without_lines(text: Column, regex: str) -> Column:
    """Without the lines that match."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(regex)), "\n")


#: Runtime log lines that tools leave in messages.
RUNTIME_LINE = r"(?i)^\s*System:\s*(\[[^\]]*\]\s*)?Exec (completed|failed|started|finished)\b.*$"

_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=\n\r"


def looks_like_base64(text: Column, least: int = 256, share: float = 0.92) -> Column:
    """A data address, or a long text of which most of the first 512 characters are of the base64 alphabet."""
    head = F.substring(text, 1, 512)
    inside = (F.length(head) - F.length(F.translate(head, _BASE64, ""))) / F.length(head)
    return text.rlike(r"^(?i)data:[a-z0-9.+-]+/[a-z0-9.+-]+;base64,") | ((F.length(text) >= least) & (inside > share))


def binary_placeholder(text: Column, mark: str = "[BINARY_CONTENT]") -> Column:
    return F.when(looks_like_base64(text), F.lit(mark)).otherwise(text)


def masked(text: Column) -> Column:
    """Keep 3 + 2 characters of long values, fewer of short ones."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = F.length(t)

    def keep(head: int, tail: int) -> Column:
        return F.concat(F.substring(t, 1, head), F.repeat(F.lit("*"), n - head - tail), F.right(t, F.lit(tail)))

    return F.when(n == 0, "").when(n == 1, "*").when(n <= 4, keep(1, 1)).when(n >= 10, keep(3, 2)).otherwise(keep(2, 2))


def deformed(text: Column) -> Column:
    """A dash after every three characters, by position."""
    return F.regexp_replace(text, r"(?s)(.{3})(?=.)", "$1-")


def deformed_words(text: Column) -> Column:
    """A dash inside words after every three characters; short words and layout stay."""
    return F.regexp_replace(text, r"(\S{3})(?=\S)", "$1-")


def excerpt(text: Column, limit: int = 180) -> Column:
    """The start of a text with its total length where it was cut."""
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("... ["), F.length(flat).cast("string"), F.lit(" chars]"))).otherwise(flat)


def hidden_count(text: Column, chars: str) -> Column:
    """How often the characters occur."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def hidden_kinds(text: Column, chars: str) -> Column:
    """How many different of the characters occur."""
    return sum((F.when(text.contains(c), 1).otherwise(0) for c in chars), F.lit(0))
