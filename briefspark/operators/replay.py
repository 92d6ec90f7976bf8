"""File state from recorded edits: sandbox tool events and canvas edits.

Replaying is an ordered fold over string edits, so it runs in grouped Python on
``events(conv_key, ord, name, input)`` where ``input`` is the JSON of one tool
call.  The group is a single path wherever a conversation has no command that
ties paths together (``cd``, ``cp``, ``mv``), else all files that come from one creation
(``replay_blocks``).  A group is read as a stream, so memory holds the live files and
not the events.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.functions.strings import read_json, valid
from briefspark.operators.ordered import first_wins, fold_sorted, hold, last_wins
from briefspark.operators.replay_blocks import replay_tied
from briefspark.operators.sandbox import Sandbox, call_of

STATE = (
    "conv_key {key}, __group string, path string, content string, place bigint, write_ord bigint, manifest_ord bigint"
)


def replay_files(events: DataFrame) -> DataFrame:
    """Final sandbox state of each conversation.

    -> (conv_key, path, content, place, write_ord, manifest_ord): live files have a
    ``place`` and ``write_ord``, entries of the last manifest a ``manifest_ord``.
    """
    key_type = dict(events.dtypes)["conv_key"]
    call = F.try_parse_json("input")
    command, path = T.variant_text(call, "$.command"), T.variant_text(call, "$.path")
    shell = F.coalesce(F.col("name").isin("bash_tool", "bash") | (command == "bash"), F.lit(False))
    plain_path = F.coalesce(~path.rlike(r"//|(^|/)\.\.?(/|\z)|/\z|['\"]"), F.lit(True))
    shaped = events.withColumn("__shell", shell).withColumn(
        "__ties",
        F.when(F.col("__shell"), F.coalesce(command.rlike(r"(^|\W)(cd|cp|mv|rm)\b"), F.lit(False)))
        .otherwise(~plain_path),
    )
    ties = shaped.filter("__ties").select("conv_key").distinct()
    full_path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(K.HOME_DIR + "/"), path))
    alone = (
        shaped.join(ties, "conv_key", "left_anti")
        .filter(~F.col("__shell"))
        .withColumn(
            "__group",
            F.when(F.col("name") == "present_files", F.lit("")).otherwise(F.coalesce(full_path, F.lit(""))),
        )
    )
    folded = fold_sorted(
        alone.select("conv_key", "__group", "ord", "name", "input"),
        ["conv_key", "__group"],
        ["ord"],
        STATE.format(key=key_type),
        _SandboxFold,
    )
    tied = events.select("conv_key", "ord", "name", "input").join(ties, "conv_key", "left_semi")
    return folded.drop("__group").unionByName(replay_tied(hold(tied)))  # it is read four times


class _SandboxFold:
    def __init__(self) -> None:
        self.box = Sandbox()

    def add(self, at, name, call) -> None:
        self.box.apply(int(at), name, call_of(call))

    def rows(self) -> list[tuple]:
        names = ("path", "content", "place", "write_ord", "manifest_ord")
        return [tuple(entry[n] for n in names) for entry in self.box.state()]


def choose_deliverables(state: DataFrame) -> DataFrame:
    """Files a reader should take along.

    The manifest and everything under the outputs folder; with neither, every
    file.  A delivered text without own content gets that of the file written
    last, flagged ``content_inferred``.
    """
    files = state.filter(F.col("place").isNotNull())
    listed = state.filter(F.col("manifest_ord").isNotNull()).select("conv_key", "path", "manifest_ord")
    picked = listed.select("conv_key", "path", F.lit(0).alias("rank"), F.col("manifest_ord").alias("ord")).unionByName(
        files.filter(F.col("path").startswith(K.OUTPUTS_DIR)).select(
            "conv_key", "path", F.lit(1).alias("rank"), F.col("place").alias("ord")
        )
    )
    delivered = picked.select("conv_key").distinct()
    rest = files.join(delivered, "conv_key", "left_anti").select(
        "conv_key", "path", F.lit(2).alias("rank"), F.col("place").alias("ord")
    )
    chosen = first_wins(picked.unionByName(rest), ["conv_key", "path"], ["rank", "ord"])
    last = last_wins(files.select("conv_key", "write_ord", "content"), ["conv_key"], ["write_ord"]).select(
        "conv_key", F.col("content").alias("last_content")
    )
    presented = listed.select("conv_key", "path", F.lit(True).alias("presented"))
    own = (
        chosen.join(files.select("conv_key", "path", "content"), ["conv_key", "path"], "left")
        .join(presented, ["conv_key", "path"], "left")
        .join(last, "conv_key", "left")
    )
    binary = T.is_binary_file(F.col("path"))
    bare = F.coalesce("content", F.lit("")) == ""
    return own.select(
        "conv_key",
        "rank",
        "ord",
        "path",
        F.coalesce(F.nullif(F.regexp_replace("path", "(?s)^.*/", ""), F.lit("")), "path").alias("filename"),
        F.when(binary, F.lit("")).when(bare, F.coalesce("last_content", F.lit(""))).otherwise(F.col("content")).alias("content"),
        binary.alias("binary"),
        F.coalesce("presented", F.lit(False)).alias("presented"),
        (~binary & bare & F.col("last_content").isNotNull()).alias("content_inferred"),
    )


# -- canvas ----------------------------------------------------------------------------


def _js_replacement(template: str):
    """The replacement text of a JS replace as a function of the match."""

    def build(m: re.Match) -> str:
        def one(t: re.Match) -> str:
            mark = t.group(1)
            if mark == "$":
                return "$"
            if mark == "&":
                return m.group(0)
            if mark == "`":
                return m.string[: m.start()]
            if mark == "'":
                return m.string[m.end() :]
            if mark.startswith("<"):
                if not m.re.groupindex:
                    return t.group(0)
                return (m.group(mark[1:-1]) or "") if mark[1:-1] in m.re.groupindex else ""
            for digits in (mark, mark[:1]):
                n = int(digits)
                if 1 <= n <= m.re.groups:
                    return (m.group(n) or "") + mark[len(digits) :]
            return t.group(0)

        return re.sub(r"\$(\$|&|`|'|<[^>]*>|\d{1,2})", one, template)

    return build


#: Seconds that one pattern of an edit may take; an edit beyond that is skipped, and counted
#: in the document's ``skipped``.
PATTERN_SECONDS = 10
_ATOM = re.compile(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|(?P<own>\(\?(?:>|P|\(|#|[a-zA-Z-]+[:)])|(?:[*+?]|\{\d+(?:,\d*)?\})\+)|.", re.DOTALL)


def _js_pattern(pattern: str) -> regex.Pattern:
    """Python form of a JS pattern: named groups, no inline dotall, ASCII classes.

    What only Python would accept (possessive loops, atomic groups, inline flags) is an
    error, as it is in JS.
    """
    if any(atom.group("own") for atom in _ATOM.finditer(pattern)):
        raise regex.error("not valid in JS", pattern)
    named = re.sub(r"\(\?<(?![=!])", "(?P<", pattern)
    named = re.sub(r"\\k<([^>]*)>", r"(?P=\1)", named)
    named = re.sub(r"(?<!\\)((?:\\\\)*)\$(?=$|\)|\|)", r"\1\\Z", named)
    named = named.replace("[^]", r"[\s\S]")
    re.compile(named, re.ASCII)  # stricter than what runs it
    return regex.compile(named, regex.ASCII | regex.V0)


def edit_canvas(doc: dict | None, recipient: str, payload_text: str | None, doc_type: str | None) -> dict | None:
    """The canvas document after one create or update event."""
    try:
        payload = read_json("{}" if payload_text is None else payload_text)
    except ValueError:
        return doc
    if not isinstance(payload, dict):
        return doc
    if "create_textdoc" in recipient:
        text = {k: valid(payload[k]) if isinstance(payload.get(k), str) else None for k in ("name", "content")}
        kind = payload.get("type")
        kind = doc_type if kind is None else kind
        return {
            "name": "canvas" if text["name"] is None else text["name"],
            "content": text["content"] or "",
            "type": valid(kind) if isinstance(kind, str) and kind else None,
        }
    if "update_textdoc" in recipient and doc is not None:
        updates = payload.get("updates")
        for u in updates if isinstance(updates, list) else []:
            if isinstance(u, dict) and isinstance(u.get("pattern"), str) and isinstance(u.get("replacement"), str):
                try:
                    found = _js_pattern(u["pattern"])
                    doc["content"] = found.sub(
                        _js_replacement(valid(u["replacement"])),
                        doc["content"],
                        count=0 if u.get("multiple") else 1,
                        timeout=PATTERN_SECONDS,
                    )
                except TimeoutError:
                    doc["skipped"] = doc.get("skipped", 0) + 1
                except (re.error, regex.error, IndexError, OverflowError, RecursionError):
                    continue
    return doc


def replay_canvas(events: DataFrame) -> DataFrame:
    """events(conv_key, ord, recipient, doc_id, doc_type, body) -> documents.

    (conv_key, first_ord, doc_id, name, doc_type, content, skipped), one fold per document.
    ``skipped`` counts the edits whose pattern took too long: a document with any lacks them.
    """
    key_type = dict(events.dtypes)["conv_key"]

    keyed = events.select(
        "conv_key", F.coalesce("doc_id", F.lit("default")).alias("doc_id"), "ord", "recipient", "body", "doc_type"
    )
    return fold_sorted(
        keyed,
        ["conv_key", "doc_id"],
        ["ord"],
        f"conv_key {key_type}, doc_id string, first_ord bigint, name string, doc_type string, content string, skipped bigint",
        _CanvasFold,
    )


class _CanvasFold:
    def __init__(self) -> None:
        self.doc, self.first = None, None

    def add(self, at, recipient, body, doc_type) -> None:
        self.doc = edit_canvas(self.doc, recipient, body, doc_type)
        if self.first is None and self.doc is not None:
            self.first = int(at)

    def rows(self) -> list[tuple]:
        d = self.doc
        return [] if d is None else [(self.first, d["name"], d["type"], d["content"], d.get("skipped", 0))]


# -- the same folds for a payload that is one row ------------------------------------------


def _with_fold(df: DataFrame, column: str, name: str, fold: Callable[[str | None], str]) -> DataFrame:
    """df + ``name``: the fold of the JSON text in ``column``, row by row in Arrow batches."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [fold(text) for text in pdf[column]]})

    return df.mapInPandas(run, ddl)


def with_sandbox_state(df: DataFrame, column: str, name: str) -> DataFrame:
    """JSON list of {name, input} of one payload -> JSON list of state entries."""

    def fold(text: str | None) -> str:
        box = Sandbox()
        for at, e in enumerate(json.loads(text) if text else []):
            box.apply(at, e.get("name"), call_of(e.get("input")))
        return json.dumps(box.state())

    return _with_fold(df, column, name, fold)


def with_canvas_docs(df: DataFrame, column: str, name: str) -> DataFrame:
    """JSON list of canvas events of one payload -> JSON list of documents."""

    def fold(text: str | None) -> str:
        docs: dict[str, dict] = {}
        for e in json.loads(text) if text else []:
            key = e.get("doc_id") or "default"
            doc = edit_canvas(docs.get(key), e.get("recipient") or "", e.get("body"), e.get("doc_type"))
            if doc is not None:
                docs[key] = doc
        return json.dumps([{"doc_id": k, **d} for k, d in docs.items()])

    return _with_fold(df, column, name, fold)
