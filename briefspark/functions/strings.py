"""Plain-Python text helpers of the few steps that run in Python."""

from __future__ import annotations

import json


def read_json(text: str | None, strict: bool = True):
    """The value of a JSON text; ValueError for anything that is none.

    ``strict`` refuses NaN and Infinity, which JSON does not have.  A text nested so deep
    that it cannot be read counts as no JSON.
    """

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse if strict else None)
    except RecursionError:
        raise ValueError("nested too deep") from None


def valid(text: str | None) -> str | None:
    """Halves of surrogate pairs, which UTF-8 cannot hold, become U+FFFD."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
