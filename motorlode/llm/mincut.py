"""Main text of a web page by minimum-cut labelling of its blocks."""

from __future__ import annotations

import html as entities
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import mapped

# Elements by their part in a page (HTML standard names).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option svg iframe object title head canvas audio video datalist".split())
CONTROLS = frozenset("a button".split())
#: A new one of these ends an open p; and each ends an open element of its own kind in the same list or table.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table menu".split())

#: What elements, roles and words of class names and ids say of what they hold, in thousandths: evidence, none of it final.
TAGS = {"nav": -9000, "footer": -9000, "menu": -9000, "dialog": -9000, "aside": -8000, "form": -8000, "header": -6000, "article": 6000, "main": 6000}
ROLES = dict.fromkeys("navigation banner contentinfo complementary search form dialog alert menu menubar".split(), -9000) | {"main": 6000, "article": 6000}
COMMENTS = frozenset("comment comments commentlist commenter disqus respond replies reply discussion reactions".split())
BAD_NAMES = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar banner ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login search share sharing social related recommended trending pagination pager copyright legal disclaimer tags hidden".split())
WEAK_NAMES = frozenset("header foot side top".split())
GOOD_NAMES = frozenset("article articles post posts postbody entry story content main maintext text body prose blog".split())
#: What follows one of these in a name is beside the element or missing: has-sidebar, no-menu.
ASIDES = frozenset("has with without no not is js".split())
COMMENT, BAD, WEAK, GOOD, INVISIBLE = -12000, -8000, -5000, 3000, -12000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Capacities in thousandths: what headings, words, link text and smoothness weigh. Words beyond SOME weigh less.
HEADING, WORD, MORE_WORDS, SOME, LINK, NEUTRAL = 600, 100, 15, 60, 7000, 500
ADJACENT, SIBLING = 700, 500


class Block:
    __slots__ = ("text", "links", "tag", "parent", "region", "depth")

    def __init__(self, text, links, tag, parent, region, depth):
        self.text, self.links, self.tag, self.parent, self.region, self.depth = text, links, tag, parent, region, depth


def name_weight(name: str) -> int:
    """What one class name or id says: any part of boilerplate decides, a weak one unless there is one of content."""
    parts = [x.lower() for x in _NAME_PART.findall(name)]
    parts = parts[: next((k for k, x in enumerate(parts) if x in ASIDES), len(parts))]
    found = [any(x in kind for x in parts) for kind in (COMMENTS, BAD_NAMES, WEAK_NAMES, GOOD_NAMES)]
    if found[0] or found[1]:
        return COMMENT if found[0] else BAD
    return (0 if found[2] else GOOD) if found[3] else WEAK if found[2] else 0


def _own_weight(tag: str, attributes: str, outer: int) -> int:
    """What an element itself says: the strongest sign of boilerplate, else the strongest of content."""
    signs = [TAGS.get(tag, 0)]
    if tag == "header" and outer > 0:  # of the article
        signs = [0]
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            signs.append(INVISIBLE)
        elif name == "role":
            signs.append(ROLES.get(value.lower(), 0))
        elif name in ("class", "id"):
            found = [name_weight(x) for x in value.split()]
            if tag in ("body", "html", "main"):  # they hold the page, whatever else it has
                found = [x for x in found if x > 0]
            elif tag == "article":
                found = [x for x in found if x > 0 or x == COMMENT]
            signs += found
    return min(signs) if min(signs) < 0 else max(signs)


def nested(outer: int, own: int) -> int:
    """Evidence within an element: its own, and a share of that around it. Content within boilerplate
    is mostly boilerplate still; boilerplate within content is so mostly too."""
    if not own:
        return outer
    if own > 0 <= outer:
        return max(own, outer) + min(own, outer) // 4
    return own + outer * (8 if own > 0 else 3) // 10 if (own > 0) != (outer > 0) else min(own, outer) + max(own, outer) // 4


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; raw elements, comments and markup are gone, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, number, region, within a link
    text: list[str] = []
    links = count = 0

    def close():
        nonlocal links
        if text:
            if whole := _SPACE.sub(" ", entities.unescape("".join(text))).strip():
                own, *above = [x for x in reversed(stack) if x[0] in BLOCKS or not x[0]]
                out.append(Block(whole, links, own[0], (above or [own])[0][1], own[2], len(stack)))
            text.clear()
        links = 0

    at, raw = 0, None
    while at < len(page):
        if raw is not None:  # until its end tag nothing is markup
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at, raw = (m.end() if m else len(page)), None
            continue
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk:
            text.append(chunk)
            if stack[-1][3]:
                links += len(chunk)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:  # a comment or declaration
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS or any(x[0] in BLOCKS for x in stack[k:]):
                        close()
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS and tag not in BLOCKS:
                    break
            else:
                if tag == "p":
                    close()
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in BLOCKS:
            close()
            for k in range(len(stack) - 1, 0, -1):  # implied end tags
                open_ = stack[k][0]
                if open_ == "p" or tag in SIBLINGS and open_ in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if open_ in BLOCKS and (open_ in LISTS or tag not in SIBLINGS):
                    break
        if tag == "br" or tag == "img":
            text.append(" ")
        if tag in RAW and tag not in ("head",) and not attributes.endswith("/"):
            raw = tag
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        count += 1
        top = stack[-1]
        stack.append((tag, count, nested(top[2], _own_weight(tag, attributes, top[2])), top[3] or tag in CONTROLS))
    close()
    return out


def capacity(b: Block) -> int:
    """The classifier's signed cost: above zero towards content, below towards boilerplate.

    A weighted sum of features: the evidence of the elements around, words, the share of link text,
    headings. Each is finite, so enough prose wins a block back from any container.
    """
    words = b.text.count(" ") + 1
    own = WORD * min(words, SOME) + MORE_WORDS * max(0, words - SOME) - NEUTRAL - LINK * min(b.links, len(b.text)) // len(b.text)
    if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        own += HEADING
    return own + b.region


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in the page, stronger under one parent, and siblings
    that others stand between; weaker the further apart in depth."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, ADJACENT // (1 + abs(found[i - 1].depth - b.depth)) + (SIBLING if found[i - 1].parent == b.parent else 0)))
        if (j := last.get(b.parent)) is not None and j < i - 1:
            out.append((j, i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(own: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut (ties: not).

    own: capacity from the source (positive) or to the sink. Nodes that outweigh all their links
    are settled first, which never changes a minimum cut; shortest augmenting paths do the rest.
    """
    n = len(own)
    own = list(own)
    side: list[bool | None] = [None] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in links:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(own[i]) > sum(near[i].values()):
            side[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    rest = {i: own[i] for i in left}
    while True:  # a shortest path from a node with flow to give to one that takes it
        came: dict[int, int] = {i: -1 for i in left if rest[i] > 0}
        queue = deque(came)
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in near[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    if rest[j] < 0:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            break
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(rest[path[-1]], -rest[end], *(near[b][a] for a, b in zip(path, path[1:])))
        rest[path[-1]] -= flow
        rest[end] += flow
        for a, b in zip(path, path[1:]):
            near[b][a] -= flow
            near[a][b] += flow
    for i in left:
        side[i] = i in came
    return side


def main_text(page: str) -> str:
    """The content blocks of a page, joined by spaces."""
    found = blocks(page)
    keep = minimum_cut([capacity(b) for b in found], edges(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) of every page from its whole html; a null one counts as empty.

    Pages without content have an empty text. Broken markup never fails: what can't be a tag is
    text, unclosed elements end with their parents.
    """

    def run(batch):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {key: batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return mapped(pages.select(key, "url", F.coalesce(F.col(html), F.lit("")).alias(html)), run, f"{key} long, url string, text string, n_chars long")
