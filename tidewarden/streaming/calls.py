"""Tool calls that stream in as fragments: assembled by index, cleaned whole, and given out as events again.

Argument fragments stay untouched until their call is whole, as a rule may match
across fragments and a fragment alone is no valid JSON.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from tidewarden.operators.scan import Rule
from tidewarden.streaming.guard import _Scanned


def read_fragments(data: str) -> list[tuple[int, str, str]]:
    """``index, name, arguments`` of the call fragments in the data of one event; data of another shape has none."""
    try:
        event = json.loads(data)
        delta = event["choices"][0]["delta"]
        calls = delta.get("tool_calls") or []
        out = []
        for c in calls:
            function = c.get("function") or {}
            out.append((int(c.get("index") or 0), function.get("name") or "", function.get("arguments") or ""))
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return []
    return [x for x in out if isinstance(x[1], str) and isinstance(x[2], str)]


class ToolCalls(_Scanned):
    """One row for each call of a stream at its end: ``index, name, arguments, outcome, event``.

    Fragments with one index are joined in order; the first name counts. ``outcome``:
    ``clean``; ``cleaned`` where a rule matched the whole arguments, which then have
    the mark in its place; ``replaced`` where the marked arguments would be no JSON
    though they were before, and the mark alone stands as a JSON text. ``event`` is
    the call as one event of the same shape, always valid JSON. Calls of a stream
    that went silent come out as they are so far.
    """

    own_schema = "calls array<struct<index:bigint,name:string,arguments:string>>"
    out_schema = "index long, name string, arguments string, outcome string, event string"

    def __init__(self, rules: Sequence[Rule], mark: str = "[REDACTED:command]", silence_ms: int | None = None, event_time: bool = False) -> None:
        super().__init__(rules, mark, silence_ms, event_time)

    def start(self) -> tuple:
        return ([],)

    def opened(self, own: tuple) -> tuple:
        return ({index: (name, [arguments]) for index, name, arguments in own[0]},)

    def closed(self, own: tuple) -> tuple:
        return ([(index, name, "".join(parts)) for index, (name, parts) in sorted(own[0].items())],)

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        for index, name, part in read_fragments(text):
            held = own[0].get(index, ("", []))
            held[1].append(part)
            own[0][index] = (held[0] or name, held[1])
        return own, self.close_silent(own) if final else [], final

    def close_silent(self, own: tuple) -> list[tuple]:
        return [self._whole(*c) for c in self.closed(own)[0]]

    def _whole(self, index: int, name: str, arguments: str) -> tuple:
        outcome, out = "clean", arguments
        if self.hit(arguments):
            outcome, out = "cleaned", self.cleaned(arguments)
            if _is_json(arguments) and not _is_json(out):
                outcome, out = "replaced", json.dumps(self.mark)
        event = {"choices": [{"delta": {"tool_calls": [{"index": index, "function": {"name": name, "arguments": out}}]}}]}
        return index, name, out, outcome, json.dumps(event, ensure_ascii=False)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True
