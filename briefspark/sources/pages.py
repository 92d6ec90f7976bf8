"""Stored web pages as a fallback source of messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K

HIDDEN = {"script", "style", "template", "noscript", "head", "title"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK_TAGS = set(
    "address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main nav ol p pre section table tr ul".split()
)
MESSAGE = "page_id {key}, ordinal bigint, role string, text string, error string"
MATCHERS = (
    lambda a, tag: "message" in (a.get("data-testid") or ""),
    lambda a, tag: "message" in (a.get("class") or ""),
    lambda a, tag: tag == "article",
    lambda a, tag: a.get("role") == "listitem",
)


class _Nodes(HTMLParser):
    """Elements that can hold a message, with their visible text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.nodes: list[dict] = []
        self.live: list[int] = []
        self.hidden = 0

    def _put(self, text: str) -> None:
        for i in self.live:
            self.nodes[i]["text"].append(text)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in BLOCK_TAGS or tag == "br":
            self._put("\n")
        if tag in VOID:
            return
        if tag in HIDDEN:
            self.hidden += 1
        hits = [m(a, tag) for m in MATCHERS]
        index = None
        if "data-message-author-role" in a or any(hits):
            index = len(self.nodes)
            self.nodes.append({"attrs": a, "hits": hits, "text": []})
            self.live.append(index)
        self.open.append((tag, index))

    def handle_endtag(self, tag):
        places = [i for i, (t, _) in enumerate(self.open) if t == tag]
        if not places:
            return
        for t, index in self.open[places[-1] :]:
            if t in HIDDEN:
                self.hidden -= 1
            if index is not None:
                self.live.remove(index)
        del self.open[places[-1] :]
        if tag in BLOCK_TAGS:
            self._put("\n")

    def handle_data(self, data):
        if not self.hidden:
            self._put(re.sub(r"[ \t\r\n\f]+", " ", data))


def _text(node: dict) -> str:
    lines = "".join(node["text"]).split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip(" ") for x in lines)).strip()


def page_messages(html: str | None) -> list[tuple[str, str]]:
    """(role, text) of the messages of a page, empty when there is no conversation."""
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    tagged = [n for n in parser.nodes if "data-message-author-role" in n["attrs"]]
    if len(tagged) >= 2:
        return [
            ("human" if n["attrs"]["data-message-author-role"] == "user" else "assistant", _text(n))
            for n in tagged
        ]
    for i in range(len(MATCHERS)):
        found = [(n, _text(n)) for n in parser.nodes if n["hits"][i]]
        found = [(n, t) for n, t in found if len(t) > K.PAGE_NODE_MIN]
        if len(found) >= 2:
            return [(_role(n["attrs"], j), t) for j, (n, t) in enumerate(found)]
    return []


def _role(attrs: dict, place: int) -> str:
    hint = (attrs["data-role"] if "data-role" in attrs else attrs.get("class", "")).lower()
    if re.search(r"user|human|you\b", hint, re.ASCII):
        return "human"
    if re.search(r"assistant|bot|ai|model|response", hint):
        return "assistant"
    return "human" if place % 2 == 0 else "assistant"


def messages_from_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, ordinal, role, text, error).

    A page without a conversation gives one row with an error.  Pages are parsed
    one by one in Arrow batches, without a shuffle.
    """
    key = dict(pages.dtypes)["page_id"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                try:
                    found, problem = page_messages(html), "no conversation found on this page"
                except (AssertionError, RecursionError) as broken:  # html.parser on broken declarations
                    found, problem = [], f"page cannot be read: {str(broken)[:100]}"
                if len(found) < 2:
                    rows.append((page, None, None, None, problem))
                else:
                    rows.extend((page, i, role, text, None) for i, (role, text) in enumerate(found))
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "role", "text", "error"]).astype(
                {"ordinal": "Int64"}
            )

    return pages.select("page_id", "html").mapInPandas(parse, MESSAGE.format(key=key))


def pages_as_messages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, errors) of the pages, ready for ``normalize_simple``."""
    rows = messages_from_pages(pages)
    messages = rows.filter(F.col("error").isNull()).select(
        F.col("page_id").alias("conv_key"), "ordinal", "role", "text"
    )
    errors = rows.filter(F.col("error").isNotNull()).select(F.col("page_id").alias("conv_key"), "error")
    return messages, errors
