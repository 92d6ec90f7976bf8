"""Main text of web pages by minimum-cut labelling of text blocks.

1. A page is read into text blocks: runs of text between the starts and ends of block
   elements, each with its path of open elements.  Head, script, style and the like, comments
   and form controls are no text.  Unclosed and crossed tags are closed as browsers do for
   the usual cases (a new ``p``, ``li``, ``td`` .. ends the old one).
2. A classifier gives each block a cost of being labelled content and a cost of being
   labelled boilerplate: from the elements around it (article and main against nav, header,
   footer, aside, form ..), from the words in class, id and role attributes, from the share
   of its characters in links, from its length and its sentences.
3. Blocks are the nodes of a flow network.  The costs are the capacities of the edges to the
   two terminals.  Smoothness edges join neighbours in page order (the stronger, the deeper
   their common element) and consecutive blocks with the same parent element.
4. The maximum flow (shortest augmenting paths) saturates a minimum cut: blocks on the
   source side are content.

A block that stands inside an element that can hold no main text (nav, aside, footer, what is
hidden ..) gets a cost that no smoothness outweighs.  Names of classes and ids, and forms, are
doubts of bounded cost, which long text, sentences and neighbours can outweigh, but for names that
say nothing else than comment, advert or notice: these hold no main text.  A doubt about an
element that holds most of the page's text, and all that stands in articles, is void.

Text: character references are decoded, white space inside a block (line breaks too) becomes
one space, blocks are trimmed and joined by a line feed.  Nothing else is dropped.

Defined cases: null, empty and text-free pages give an empty text; a page without any tag is
one block of content; broken markup is read as far as it goes, an unclosed ``script`` or comment
swallows the rest, a tag that never ends is text, elements nested beyond DEEPEST are side by side;
reading takes time in proportion to the page; repeated rows stay; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.common import map_batches, table

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text of the page.
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video title select textarea button datalist noframes noembed".split())
#: Of these, the ones that hold raw characters up to their end tag.
RAW = frozenset("script style textarea title iframe noframes noembed".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these kinds, up to the nearest boundary.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
    "option": ("option",), "body": ("head",),
}
BOUNDARY = frozenset("ul ol dl menu table html body".split())
ENDS_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "dd", "dt", "li"} | {"p", "li", "dd", "dt"}

#: A comment, or the start of a tag up to the end of its name.
OPENING = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)",
    re.DOTALL,
)
QUOTE_OR_END = re.compile("[\"'>]")
#: Elements deeper than this are side by side, as in browsers.
DEEPEST = 512
MARKS = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?。！？…](?=\s|$)")

#: Costs, in units of doubt: FIRM outweighs any smoothness a block can have.
FIRM = 10_000
BAD_ELEMENTS = frozenset("nav header footer aside dialog menu search".split())
DOUBTFUL_ELEMENTS = frozenset("form fieldset".split())
BAD_ROLES = frozenset("navigation complementary contentinfo banner search dialog menu menubar".split())
#: Doubts by names: the whole name or a word of NEVER_MAIN; a word among others.
STRONG, WEAK = 400, 180
#: Characters of a block that is short if another one of the page is long.
SHORT, LONG = 25, 80
GOOD_ELEMENTS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc sidebar side aside rail "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search widget widgets copyright legal disclaimer tags skip "
    "contentinfo complementary hidden form".split()
)
GOOD_WORDS = frozenset("article articlebody main content body post entry story".split())


#: Words that speak against an element also where it is called article or main.
NEVER_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo comment comments commentlist disqus reply replies "
    "related recommended alert notice notices cookie cookies consent gdpr newsletter popup modal".split()
)
#: Words of names that only say that an element holds something.
HOLDERS = frozenset("list thread section block area box wrapper wrap container item items body text content unit slot inner outer group".split())
#: First words of names that say what a page has, not what the element is.
HAS = frozenset("has with no non not without is js wp".split())
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: A class that shows from some width on what the class ``hidden`` hides below it.
RESPONSIVE = re.compile(r"\S+:(?:block|flex|grid|inline\S*|table\S*|contents)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marks(name: str, attributes: str, inside: bool) -> tuple[int, bool, bool, bool, bool]:
    """(doubt, whether a word of NEVER_MAIN makes it, whether a name says nothing else, whether only
    ids make it, good) by attributes; inside: of an article, whose own header may hold its headline."""
    doubt, never, firm, kept, good = 0, False, False, True, False
    for field, value in MARKS.findall(attributes):
        field = field.lower()
        if field in ("hidden", "aria-hidden"):
            if field == "hidden" or "true" in value.lower():
                doubt = FIRM
            continue
        tokens = value.strip("\"'").split()
        shown = field == "class" and any(RESPONSIVE.fullmatch(t) for t in tokens)
        for token in tokens:
            words = WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", token).lower())
            if not words or len(words) > 1 and words[0] in HAS or shown and token == "hidden":
                continue
            good = good or not GOOD_WORDS.isdisjoint(words)
            if field == "role" and token.lower() in BAD_ROLES and name not in GOOD_ELEMENTS and not (inside and token.lower() == "banner"):
                doubt = FIRM
            against = BAD_WORDS & set(words)
            if name in GOOD_ELEMENTS:
                against &= NEVER_MAIN
            if inside:
                against -= {"header", "head"}
            if not against or field == "id" and name in HEADINGS:  # an anchor, spelt as the heading
                continue
            unlikely = bool(against & NEVER_MAIN)
            if field == "id" and inside and (len(words) > 1 or not unlikely):
                doubt = max(doubt, WEAK)
                continue
            doubt = max(doubt, STRONG if unlikely or 2 * len(against) > len(words) else WEAK)
            never, kept = never or unlikely, False
            firm = firm or unlikely and BAD_WORDS.issuperset(w for w in words if w not in HOLDERS)
    if "idden" in attributes and re.search(r"(?i)(?:^|\s)hidden(?:\s|$)", QUOTED.sub('""', attributes)):
        doubt = FIRM
    if UNSHOWN.search(attributes):
        doubt = FIRM
    return doubt, never, firm, kept, good


class Tags:
    """The tags of a page in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end_of(self, at: int) -> int:
        """The place of the ``>`` that ends a tag: the next one outside quotes.  A quote that is never
        closed is none, and if all are inside quotes, the next one ends the tag."""
        page, begin = self.page, at
        while found := QUOTE_OR_END.search(page, at):
            quote, at = found[0], found.end()
            if quote == ">":
                return at - 1
            if at <= self.last[quote]:
                at = page.index(quote, at) + 1
        return page.index(">", begin)

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it ends an element, name, attributes) of the next tag or comment."""
        found = OPENING.search(self.page, at)
        if found is None:
            return None
        if found[2] is None:
            return found.start(), found.end(), False, None, ""
        if found.end() > self.last[">"]:  # no tag ends any more; a comment may still come
            found = re.compile("<[!?]").search(self.page, found.start())
            return self.after(found.start()) if found else None
        end = self.end_of(found.end())
        return found.start(), end + 1, bool(found[1]), found[2].lower(), self.page[found.end() : end]


class Element:
    __slots__ = ("name", "parent", "owner", "depth", "bad", "good", "doubt", "never", "firm", "doubted", "held", "held_good")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        #: the nearest block element
        self.owner = self if name in BLOCKS or parent is None else parent.owner
        self.depth = parent.depth + 1 if parent else 0
        inside = parent.good if parent else False
        marked = attributes and name not in ("html", "body")
        doubt, self.never, self.firm, kept, good = _marks(name, attributes, inside) if marked else (0, False, False, True, False)
        if name in DOUBTFUL_ELEMENTS and doubt < STRONG:
            doubt, kept = STRONG, False
        # a header inside an article may hold its headline; elsewhere it is the page's
        kind = name in BAD_ELEMENTS and not (name == "header" and inside)
        self.bad = (parent.bad if parent else False) or kind or doubt == FIRM
        self.doubt = 0 if self.bad else doubt
        above = parent.doubted if parent else None
        #: the innermost element in doubt, this one or around it
        self.doubted = self if self.doubt else above
        named_good = name in GOOD_ELEMENTS or good and not above
        self.good = not self.bad and kept and (inside or named_good and not self.doubt)
        self.held = self.held_good = 0


class Block:
    __slots__ = ("element", "text", "linked", "heading")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked
        self.heading = element.name in HEADINGS


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Element("#root", None, "")
    stack: list[Element] = [root]
    blocks: list[Block] = []
    parts: list[str] = []
    linked = unseen = links = 0
    at, size = 0, len(page)
    tags, opened = Tags(page), Counter()  # open elements of each name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(stack[-1].owner, text, linked))
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal unseen, links
        if stack[-1].name in BLOCKS:
            flush()
        gone = stack.pop()
        opened[gone.name] -= 1
        unseen -= gone.name in UNSEEN
        links -= gone.name == "a"

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            shown = html.unescape(raw) if "&" in raw else raw
            parts.append(shown)
            if links:
                linked += len(shown.strip())

    while at < size:
        tag = tags.after(at)
        if tag is None:
            text(page[at:])
            break
        start, end, ends, name, attributes = tag
        text(page[at:start])
        at = end
        if name is None:
            continue
        if ends:
            if name == "br":
                text(" ")
            elif name == "p" and not opened["p"]:
                flush()
            elif opened[name]:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].name == name:
                        while len(stack) > n:
                            pop()
                        break
                    if name not in BLOCKS and stack[n].name in BLOCKS:
                        if name == "a" and links:  # a link over several blocks
                            continue
                        break
                    if stack[n].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "article", "section", "main"):
                        break
            continue
        closes = ENDS.get(name, ())
        if name in ENDS_P and opened["p"]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name == "p":
                    while len(stack) > n:
                        pop()
                    break
                if stack[n].name in BLOCKS or stack[n].name in UNSEEN:
                    break
        if any(opened[c] for c in closes):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name in closes:
                    while len(stack) > n:
                        pop()
                elif stack[n].name in BOUNDARY and not (name == "body" and stack[n].name == "html"):
                    break
        if name in BLOCKS:
            flush()
        elif name == "br":
            text(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in UNSEEN:
            continue
        if name in RAW:
            closed = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = closed.end() if closed else size
            continue
        if len(stack) > DEEPEST:
            pop()
        stack.append(Element(name, stack[-1], attributes))
        opened[name] += 1
        unseen += name in UNSEEN
        links += name == "a"
    flush()
    return blocks


def _doubted(block: Block) -> Iterator[Element]:
    """The elements in doubt around a block, from inside out."""
    at = block.element.doubted
    while at is not None:
        yield at
        at = at.parent.doubted if at.parent else None


def weigh(blocks: list[Block]) -> None:
    """Clears doubts about elements that hold most of the page's text and all of its articles."""
    total = total_good = 0
    seen: dict[int, Element] = {}
    for block in blocks:
        if block.element.bad:
            continue
        chars = len(block.text)
        total += chars
        total_good += chars * block.element.good
        for e in _doubted(block):
            seen[id(e)] = e
            e.held += chars
            e.held_good += chars * block.element.good
    for e in seen.values():
        if 2 * e.held > total and e.held_good == total_good and (not e.never or 2 * e.held_good > e.held):
            e.doubt = 0


def costs(block: Block, longest: int = LONG) -> tuple[int, int]:
    """(cost of the label content, cost of the label boilerplate); ``longest``: of the page's blocks."""
    if block.element.bad or any(e.firm and e.doubt for e in _doubted(block)):
        return FIRM, 0
    doubt = max((e.doubt for e in _doubted(block)), default=0)
    as_content, as_boilerplate = 20 + doubt, 21  # what nothing speaks against is content
    if block.element.good:
        as_boilerplate += 120
    chars = len(block.text)
    share = block.linked / chars
    if share > 0.5:
        as_content += int((80 if block.element.good else 160) * share)
    else:
        as_boilerplate += min(chars, 200) // 4
        as_boilerplate += 20 * min(3, len(SENTENCE.findall(block.text)))
        if doubt:
            as_boilerplate += min(max(chars - 200, 0), 3200) // 8
    if block.element.name in ("p", "pre", "blockquote") or block.heading:
        as_boilerplate += 25
    if chars < SHORT and longest >= LONG and not block.heading and not block.element.good:
        as_content += 40
    if not block.element.good and re.match(r"(?i)\s*(?:©|\(c\) |copyright\b|all rights reserved)", block.text):
        as_content += 200
    return as_content, as_boilerplate


def _common_depth(a: Element, b: Element) -> int:
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b:
        a, b = a.parent, b.parent
    return a.depth


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in page order, and siblings."""
    edges, last_child = [], {}
    for n, block in enumerate(blocks):
        if n:
            near = blocks[n - 1].element
            far = max(near.depth, block.element.depth) - _common_depth(near, block.element)
            edges.append((n - 1, n, 60 // (1 + far)))
        parent = id(block.element.parent or block.element)
        if parent in last_child and last_child[parent] != n - 1:
            edges.append((last_child[parent], n, 15))
        last_child[parent] = n
    return [e for e in edges if e[2]]


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (the smallest such side).

    source, sink: capacities to the terminals.  Flow that a node passes straight from
    source to sink is pushed first; the rest goes along shortest augmenting paths.
    """
    size = len(source)
    left = [a - min(a, b) for a, b in zip(source, sink)]
    drain = [b - min(a, b) for a, b in zip(source, sink)]
    residual: list[dict[int, int]] = [{} for _ in range(size)]
    for a, b, capacity in edges:
        residual[a][b] = residual[a].get(b, 0) + capacity
        residual[b][a] = residual[b].get(a, 0) + capacity
    for start in range(size):
        while left[start]:
            came, queue, end = {start: -1}, deque([start]), -1
            while queue:
                at = queue.popleft()
                if drain[at]:
                    end = at
                    break
                for to, capacity in residual[at].items():
                    if capacity and to not in came:
                        came[to] = at
                        queue.append(to)
            if end < 0:
                break
            path, at = [], end
            while at != start:
                path.append((came[at], at))
                at = came[at]
            pushed = min([left[start], drain[end], *(residual[a][b] for a, b in path)])
            left[start] -= pushed
            drain[end] -= pushed
            for a, b in path:
                residual[a][b] -= pushed
                residual[b][a] += pushed
    side = [bool(x) for x in left]
    queue = deque(n for n in range(size) if side[n])
    while queue:
        for to, capacity in residual[queue.popleft()].items():
            if capacity and not side[to]:
                side[to] = True
                queue.append(to)
    return side


def main_text(page: str | None) -> str:
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    if len(blocks) == 1 and "<" not in page:
        return blocks[0].text
    weigh(blocks)
    longest = max(len(b.text) for b in blocks)
    pairs = [costs(b, longest) for b in blocks]
    side = min_cut([b for _, b in pairs], [a for a, _ in pairs], smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, side) if content)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_batches(
        pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
