"""Exact values replaced in streams, also where a value spans chunks.

A stream's state is the end of its text that isn't settled yet. Each chunk's text
is put behind it and run through one automaton of all values. A match counts once
nothing can overrule it: longer values win over shorter ones, of one value the
earlier match wins, as if the values were replaced one after the other in the whole
text, longest first. What lies before the first open match and before the longest
beginning of a value at the text's end is settled and goes out. The unsettled end is
no longer than the values that may overrule each other, each once; without overlaps
than the longest value.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick

from tidewarden.operators.rewrite import listed_values
from tidewarden.streaming.ordered import OrderedStream


class ValueFinder:
    """The values as an automaton, and how far a text's end may be the beginning of one."""

    def __init__(self, values: Sequence[str], least: int = 10) -> None:
        self.values = listed_values(values, least)
        self.longest = max(map(len, self.values), default=0)
        self.beginnings = {v[:k] for v in self.values for k in range(1, len(v))}
        self.automaton = ahocorasick.Automaton()
        for rank, v in enumerate(self.values):
            self.automaton.add_word(v, (rank, len(v)))
        if self.values:
            self.automaton.make_automaton()

    def live(self, text: str) -> int:
        """Length of the longest end of the text that a value begins with."""
        return next((k for k in range(min(len(text), self.longest - 1), 0, -1) if text[-k:] in self.beginnings), 0)

    def settle(self, text: str, final: bool) -> tuple[list[tuple[int, int]], int]:
        """Matches that count, in order of place, and the length of the settled text."""
        if not self.values:
            return [], len(text)
        settled = len(text) if final else len(text) - self.live(text)
        found = sorted((rank, end + 1 - size, end + 1) for end, (rank, size) in self.automaton.iter(text))
        if not found:
            return [], settled
        # 1: taken by a match that counts, 2: by one that may still be overruled
        held, counted, cut = bytearray(len(text)), [], settled
        for _, start, end in found:
            here = held[start:end]
            if 1 in here:
                continue
            if 2 in here or end > settled:
                held[start:end] = b"\2" * (end - start)
                cut = min(cut, start)
            else:
                held[start:end] = b"\1" * (end - start)
                counted.append((start, end))
        return sorted(m for m in counted if m[1] <= cut), cut


class ExactValues(OrderedStream):
    """Text of the streams with listed values replaced: ``seq, text, count``, whose texts joined are the whole text."""

    own_schema = "pending string, seq long"
    out_schema = "seq long, text string, count long"

    def __init__(self, values: Sequence[str], mark: str = "[REDACTED:EXACT]", least: int = 10, silence_ms: int | None = None, event_time: bool = False) -> None:
        super().__init__(silence_ms, event_time)
        self.values, self.mark, self.least = list(values), mark, least
        self.finder: ValueFinder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finder": None}  # built once in each worker

    def start(self) -> tuple:
        return "", -1

    def _settled(self, text: str, final: bool) -> tuple[str, str, int]:
        self.finder = self.finder or ValueFinder(self.values, self.least)
        found, cut = self.finder.settle(text, final)
        out, at = [], 0
        for start, end in found:
            out += [text[at:start], self.mark]
            at = end
        return "".join([*out, text[at:cut]]), text[cut:], len(found)

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        out, pending, count = self._settled(own[0] + text, final)
        return (pending, seq), [(seq, out, count)] if out else [], final

    def close_silent(self, own: tuple) -> list[tuple]:
        out, _, count = self._settled(own[0], True)
        return [(own[1], out, count)] if out else []
