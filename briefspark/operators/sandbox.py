"""What the tool calls of a sandbox session do to its files, one call at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from briefspark.functions import constants as K
from briefspark.functions.strings import read_json, valid

#: Bits of a stamp that number the operations of one event.
STAMP_BITS = 20


def stamp_of(at: int, n: int) -> int:
    return (at << STAMP_BITS) + n + 1


def bare(path: str) -> str:
    """A path without one quote at either end."""
    return re.sub(r"^['\"]|['\"]$", "", path)


def joined(base: str, path: str) -> str:
    """``path`` as seen from ``base``, in normal form.

    A relative base gives a relative result (``.`` is no move at all), so moves between
    folders compose: joined(joined(a, b), c) == joined(a, joined(b, c)).
    """
    whole = path if path.startswith("/") else f"{base}/{path}"
    rooted = whole.startswith("/")
    parts: list[str] = []
    for step in whole.split("/"):
        if step == ".." and parts and parts[-1] != "..":
            parts.pop()
        elif step == "..":
            parts.extend([] if rooted else [step])
        elif step not in ("", "."):
            parts.append(step)
    return "/" + "/".join(parts) if rooted else "/".join(parts) or "."


def _field(call: dict, key: str) -> str | None:
    value = call.get(key)
    return valid(value) if isinstance(value, str) else None


def _shell(line: str) -> Iterator[tuple[str, str, str]]:
    for command in re.split(r"&&|;|\n", line):
        words = [a or b or c for a, b, c in re.findall(r'"([^"]*)"|\'([^\']*)\'|(\S+)', command)]
        verb, rest = (words[0], words[1:]) if words else ("", [])
        plain = [bare(w) for w in rest if not w.startswith("-")]
        if verb == "cd" and rest and rest[0]:
            yield "cd", bare(rest[0]), ""
        elif verb == "rm":
            yield from (("rm", w, "") for w in plain)
        elif verb in ("cp", "mv") and len(plain) > 1:
            yield verb, plain[0], plain[-1]


def operations(name: str | None, call: dict) -> list[tuple[str, str, str]]:
    """What a tool call asks for, as (kind, path, target): ``put``, ``edit``, ``insert``, ``rm``,
    ``cp``, ``mv``, ``cd`` with paths as they are written, or ``show`` with a JSON list of paths."""
    command, path = _field(call, "command"), _field(call, "path")
    if path and (name == "create_file" or command == "create"):
        return [] if _field(call, "file_text") is None else [("put", bare(path), "")]
    if path and "str_replace" in (name, command):
        return [("edit", bare(path), "")]
    if path and "insert" in (name, command):
        return [("insert", bare(path), "")]
    if name in ("bash_tool", "bash") or command == "bash":
        return list(_shell(command or ""))
    if name == "present_files":
        listed = call.get("filepaths")
        listed = call.get("file_paths") if listed is None else listed
        if isinstance(listed, list):
            paths = [joined("/", bare(valid(p))) for p in listed if isinstance(p, str)]
            return [("show", json.dumps(list(dict.fromkeys(paths))), "")]
    return []


def rewritten(kind: str, call: dict, text: str | None) -> str | None:
    """The text of a file after a ``put``, ``edit`` or ``insert``; None if it is not written."""
    if kind == "put":
        return _field(call, "file_text")
    if kind == "edit":
        old = _field(call, "old_str") or ""
        return None if text is None or old not in text else text.replace(old, _field(call, "new_str") or "", 1)
    at = call.get("insert_line")
    at = at if isinstance(at, (int, float)) and not isinstance(at, bool) else 0
    new = _field(call, "insert_text")
    lines = (text or "").split("\n")
    at = int(min(max(at, 0), len(lines)))  # a place beyond the end, or infinite, appends
    lines.insert(at, (_field(call, "new_str") or "") if new is None else new)
    return "\n".join(lines)


class Files:
    """Live files; a dict keeps the first-write order of the paths.

    Every write is stamped with (event, operation inside the event) so that states
    replayed apart from each other still sort into one order.
    """

    def __init__(self) -> None:
        self.text: dict[str, str] = {}
        self.place: dict[str, int] = {}
        self.written: dict[str, int] = {}
        self.manifest: list[str] = []

    def write(self, stamp: int, path: str, text: str) -> None:
        if path not in self.text:
            self.place[path] = stamp
        self.text[path] = text
        self.written[path] = stamp

    def forget(self, path: str) -> None:
        self.text.pop(path, None)
        self.written.pop(path, None)

    def do(self, stamp: int, kind: str, path: str, target: str, call: dict) -> None:
        """One operation on absolute paths."""
        if kind in ("cp", "mv"):
            if path in self.text:
                self.write(stamp, target, self.text[path])
            if kind == "mv":
                self.forget(path)
        elif kind == "rm":
            self.forget(path)
        elif kind == "show":
            self.manifest = json.loads(path)
        else:
            text = rewritten(kind, call, self.text.get(path))
            if text is not None:
                self.write(stamp, path, text)


class Sandbox(Files):
    """The files of a session and its working folder."""

    def __init__(self) -> None:
        super().__init__()
        self.cwd = K.HOME_DIR

    def apply(self, at: int, name: str | None, call: dict) -> None:
        for n, (kind, path, target) in enumerate(operations(name, call)):
            if kind == "cd":
                self.cwd = joined(self.cwd, path)
            elif kind == "show":
                self.do(0, kind, path, "", call)
            else:
                self.do(stamp_of(at, n), kind, joined(self.cwd, path), joined(self.cwd, target), call)

    def state(self) -> list[dict]:
        """One entry per live file, then one per manifest entry."""
        files = [
            {"path": p, "content": t, "place": self.place[p], "write_ord": self.written[p], "manifest_ord": None}
            for p, t in self.text.items()
        ]
        listed = [
            {"path": p, "content": None, "place": None, "write_ord": None, "manifest_ord": i}
            for i, p in enumerate(self.manifest)
        ]
        return files + listed


def call_of(text) -> dict:
    try:
        value = read_json(text) if isinstance(text, str) else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}
