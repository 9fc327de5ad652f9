"""Cheap tests that a text must pass before a rule's regex is tried on it.

A gate is a regex without look-around, boundaries or upper bounds, for lowered
texts, that matches wherever the rule matches (and in some other places). Engines
in linear time (Arrow's) run gates over whole columns, many times faster than the
rules themselves. Rules without a gate count as passed.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from functools import lru_cache
from re import _parser as parser  # the standard library's own regex parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

_ANY = r"(?s:.)"
_SPACE = {9, 10, 11, 12, 13, 32}
_CLASSES = {"CATEGORY_DIGIT": set(range(48, 58)), "CATEGORY_SPACE": _SPACE, "CATEGORY_WORD": {*range(48, 58), *range(65, 91), *range(97, 123), 95}}
#: Copies that a repetition asks for at most; longer ones ask for fewer.
_COPIES = 64
#: Gates that are tried as one first.
_AT_ONCE = 8


class _NoGate(Exception):
    pass


def _plain(code: int) -> str:
    """One character of a class or a literal."""
    return rf"\x{{{code:x}}}"


def _uncased(low: int, high: int) -> bool:
    """Ideographs, kana and the like, and signs of layout: they have no case, and no letter's lower case has them."""
    return any(a <= low and high <= b for a, b in ((0x2E80, 0x9FFF), (0x2000, 0x206F), (0xFEFF, 0xFEFF), (0xAD, 0xAD)))


def _one_of(members) -> str:
    """A class as it matches lowered texts."""
    held, wide, negated = set(), [], False
    for op, value in members:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL" and value == 91:
            raise _NoGate  # perhaps a class within a class, which the two parsers read differently
        elif name == "LITERAL" and value < 128:
            held.add(value)
        elif name == "RANGE" and value[1] < 128:
            held |= set(range(value[0], value[1] + 1))
        elif name == "CATEGORY" and str(value) in _CLASSES:
            held |= _CLASSES[str(value)]
        elif name in ("LITERAL", "RANGE") and _uncased(*(value if name == "RANGE" else (value, value))):
            wide.append(value if name == "RANGE" else (value, value))
        elif str(value) == "CATEGORY_NOT_SPACE" and len(members) == 1:
            held, negated = _SPACE, True
        else:
            return _ANY
    if negated and (wide or any(chr(c).isalpha() for c in held)):
        return _ANY
    held = {ord(chr(c).lower()) for c in held}
    return f"[{'^' if negated else ''}{''.join(map(_plain, sorted(held)))}{''.join(f'{_plain(a)}-{_plain(b)}' for a, b in wide)}]"


def _gate(tree) -> str:
    out = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(_plain(ord(chr(value).lower())) if value < 128 or _uncased(value, value) else _ANY)
        elif name == "NOT_LITERAL":
            out.append(_ANY if value >= 128 or chr(value).isalpha() else f"[^{_plain(value)}]")
        elif name == "IN":
            out.append(_one_of(value))
        elif name == "ANY":
            out.append(_ANY)
        elif name == "BRANCH":
            out.append(f"(?:{'|'.join(_gate(x) for x in value[1])})")
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            out.append(f"(?:{_gate(value[3] if name == 'SUBPATTERN' else value)})")
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            asked = min(least, _COPIES)
            if (asked, most) != (0, 0):
                out.append(f"(?:{_gate(inner)})" + (f"{{{asked}}}" if asked == most else "?" if (asked, most) == (0, 1) else f"{{{asked},}}"))
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise _NoGate
    return "".join(out)


@lru_cache(maxsize=None)
def gate(regex: str) -> str | None:
    """The gate of a rule's regex, or None where none is known or it lets all texts pass."""
    if "\\Q" in regex or re.search(r"\[(?:\\.|[^\]])*&&", regex):  # quotation, intersection of classes
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            tree = parser.parse(regex)
        if tree.state.flags & 64:  # blanks that don't count
            return None
        found = _gate(tree)
        empty = pc.match_substring_regex(pa.array([""]), found)[0].as_py()
    except (_NoGate, re.error, pa.ArrowInvalid):
        return None
    return None if empty else found


def _tried(texts: pa.Array, regexes: Sequence[str]) -> np.ndarray:
    """Which texts (rows) pass which gates (columns): all together first, then each where one does."""
    out = np.zeros((len(texts), len(regexes)), bool)
    some = pc.fill_null(pc.match_substring_regex(texts, "|".join(regexes)), False)
    rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    if len(regexes) == 1 or not len(rows):
        out[rows] = True
        return out
    held = texts.take(pa.array(rows))
    for i, regex in enumerate(regexes):
        out[rows, i] = pc.match_substring_regex(held, regex).to_numpy(zero_copy_only=False)
    return out


def _passes(regexes: tuple[str | None, ...]) -> Callable[[pa.Array], pa.Array]:
    known = [i for i, r in enumerate(regexes) if r is not None]

    def run(texts: pa.Array) -> pa.Array:
        out = np.ones((len(texts), len(regexes)), bool)
        for at in range(0, len(known), _AT_ONCE):
            part = known[at : at + _AT_ONCE]
            out[:, part] = _tried(texts, [regexes[i] for i in part])
        offsets = np.arange(0, out.size + 1, len(regexes), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return run


def passed(lowered: Column, regexes: Sequence[str]) -> Column:
    """An array with, for each regex of a rule, whether the lowered text passes its gate; it must be a column of its own before it is used."""
    run = _passes(tuple(map(gate, regexes)))

    @F.arrow_udf(ArrayType(BooleanType()))
    def gates(texts: pa.Array) -> pa.Array:
        return run(texts)

    return gates(lowered)
