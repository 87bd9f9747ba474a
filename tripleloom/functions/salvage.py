"""JSON out of a model's answer."""

from __future__ import annotations

import json
import re

FENCE = re.compile(r"```(?:json)?\s*", re.IGNORECASE)


def salvage(text: str | None) -> str | None:
    """The JSON value of a whole text without code fences, else the last object between balanced braces; null without any."""
    if not text:
        return None
    bare = FENCE.sub("", text).strip()
    try:
        return json.dumps(json.loads(bare), sort_keys=True)
    except ValueError:
        pass
    depth = begin = 0
    found = None
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif (depth := depth - 1) == 0:
            try:
                found = json.dumps(json.loads(bare[begin : m.end()]), sort_keys=True)
            except ValueError:
                continue
    return found
