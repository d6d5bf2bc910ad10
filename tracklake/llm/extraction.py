"""Main text of web pages by tag-path ratios.

Every run of text belongs to the path of tags from the root to it.  Per page and path
the length of the text and its punctuation are summed and divided by the number of
runs, both ratios are smoothed along the page, fused, and a threshold relative to the
page's mean picks the paths that carry running text.  The smallest element that holds
all of that text and all headings is the article (a single ``article`` or ``main`` is it by
its mark); its blocks are returned in page order, without the parts that are navigation, adverts, forms, notices or comments by their tag, role or class.

Defined results: a null or empty page, and one without text, give the empty string.
Broken markup is read leniently: unclosed elements end with their parent, an
unfinished tag at the end is dropped, stray end tags are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Kinds of HTML elements.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dt", "dd", "figcaption", "caption", "th"}
#: Elements that end when another of the listed ones begins beside them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
#: Scopes that an implied end tag does not leave.
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body"}
NOT_TEXT = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"}
NOT_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
NOT_TEXT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|adslot|banner\w*|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|sidebar\w*|widget\w*|related|recommend\w*"
    r"|share|sharing|social|cookies?|cookie\w+|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|comments?|commentlist|disqus|repl(?:y|ies)|respond|pagination|pager|toolbar|skip|copyright|login|signup|hidden)(?:$|[\s_-])"
)
SITE_HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])")
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|repl(?:y|ies)|disqus)(?:$|[\s_-])")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

#: Runs on either side that enter the smoothed ratio of a run, and the share of the mean it must reach.
SMOOTH_RUNS = 1
MEAN_SHARE = 0.5
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass(slots=True)
class Element:
    tag: str
    parent: "Element | None"
    path: str
    dropped: bool
    in_article: bool
    needed: int = 0  # runs of running text and headings inside
    children: list = field(default_factory=list)


@dataclass(slots=True)
class Run:
    """Text of one block that stands at one place of the tree."""

    owner: Element
    parts: list
    link_chars: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _drops(tag: str, attributes: dict[str, str], parent: Element) -> bool:
    """Whether an element is no running text by its kind."""
    if tag in NOT_TEXT or tag == "header" and not parent.in_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return bool(COMMENT_WORDS.search(words))
    return bool(NOT_TEXT_WORDS.search(words)) or not parent.in_article and bool(SITE_HEADER_WORDS.search(words))


def parse(page: str) -> tuple[Element, list[Run]]:
    """The tree of a page and its runs of text in page order, entities decoded."""
    root = Element("", None, "", False, False)
    here, block, runs, links = root, None, [], 0

    def end(element: Element) -> Element:
        return element.parent or root

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        owner = here
        while owner.tag in INLINE:
            owner = end(owner)
        if block is None or block.owner is not owner:
            if not raw.strip():
                return
            block = Run(owner, [])
            runs.append(block)
        shown = entities.unescape(raw) if "&" in raw else raw
        block.parts.append(shown)
        if links:
            block.link_chars += len(shown.strip())

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or m[4] is not None:  # comment, declaration, or a tag cut off by the end of the page
            continue
        tag = tag.lower()
        if m[1]:
            found = here
            while found is not root and found.tag != tag and not (tag in INLINE and found.tag not in INLINE):
                found = end(found)
            if found is root or found.tag != tag:
                continue
            while True:
                links -= here.tag == "a"
                gone, here = here, end(here)
                if gone is found:
                    break
            if tag not in INLINE:
                block = None
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            elif tag == "br":
                text(" ")
            continue
        if tag not in INLINE:
            block = None
            closing = ENDED_BY_START.get(tag, set()) | {"p"}
            probe = here
            while probe is not root and probe.tag not in closing and probe.tag not in SCOPES:
                probe = end(probe)
            if probe is not root and probe.tag in closing:
                while here is not probe:
                    links -= here.tag == "a"
                    here = end(here)
                here = end(probe)
        attributes = _attributes(m[3])
        dropped = here.dropped or _drops(tag, attributes, here)
        name = tag if not attributes.get("class") else f"{tag}.{attributes['class'].split()[0]}" if attributes["class"].split() else tag
        child = Element(tag, here, here.path if tag in INLINE and tag != "a" else f"{here.path}/{name}", dropped, here.in_article or tag in ("article", "main"))
        if tag not in INLINE:
            here.children.append(child)
        if not m[3].rstrip().endswith("/") or tag not in INLINE:
            here = child
            links += tag == "a"
    for run in runs:
        run.text = SPACE.sub(" ", "".join(run.parts)).strip()
    return root, [r for r in runs if r.text]


ENDED_BY_START: dict[str, set[str]] = {}
for _open, _starters in ENDED_BY.items():
    for _starter in _starters:
        ENDED_BY_START.setdefault(_starter, set()).add(_open)


def path_scores(runs: list[Run]) -> dict[str, float]:
    """Fused ratio of each path: smoothed text length and punctuation per run of the path."""
    length: dict[str, float] = {}
    marks: dict[str, float] = {}
    number: dict[str, int] = {}
    for r in runs:
        p = r.owner.path
        length[p] = length.get(p, 0) + max(0, len(r.text) - r.link_chars)
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(r.text)) * (r.link_chars < len(r.text) / 2)
        number[p] = number.get(p, 0) + 1
    ratio = [(length[r.owner.path] / number[r.owner.path], marks[r.owner.path] / number[r.owner.path]) for r in runs]
    total: dict[str, float] = {}
    for i, r in enumerate(runs):
        near = ratio[max(0, i - SMOOTH_RUNS) : i + SMOOTH_RUNS + 1]
        smooth = [(ratio[i][k] + sum(x[k] for x in near) / len(near)) / 2 for k in (0, 1)]
        total[r.owner.path] = total.get(r.owner.path, 0.0) + smooth[0] * (1 + smooth[1])
    return {p: total[p] / number[p] for p in total}


def _only(runs: list[Run], tag: str) -> Element | None:
    """The outermost element of this kind that holds text, if there is exactly one."""
    found: dict[int, Element] = {}
    for r in runs:
        outer, element = None, r.owner
        while element is not None:
            if element.tag == tag:
                outer = element
            element = element.parent
        if outer is not None:
            found[id(outer)] = outer
    return next(iter(found.values())) if len(found) == 1 else None


def extract(page: str | None) -> str:
    """The article's text: blocks in page order, one per line, white space inside a block as one space."""
    if not page:
        return ""
    root, found = parse(page)
    runs = [r for r in found if not r.owner.dropped]
    if not runs:
        return ""
    scores = path_scores(runs)
    # the mean over running characters; paths below its share carry labels, links and other short text
    mean = sum(scores[r.owner.path] * len(r.text) for r in runs) / sum(len(r.text) for r in runs)
    chosen = {p for p, s in scores.items() if s >= MEAN_SHARE * mean}

    def only_links(r: Run) -> bool:
        return r.owner.path not in chosen and r.link_chars > 0.8 * len(r.text)

    for r in runs:
        if r.owner.path in chosen or r.owner.tag in HEADINGS and not only_links(r):
            element = r.owner
            while element is not None:
                element.needed += 1
                element = element.parent
    # a page that marks its one article or main part says where it is; else the search starts at the root and leaves nothing needed behind
    place = _only(runs, "article") or _only(runs, "main") or root
    while place.needed and place.tag not in ("article", "main"):
        inner = next((c for c in place.children if c.tag not in LEAVES and c.needed == place.needed), None)
        if inner is None:
            break
        place = inner

    def inside(element: Element | None) -> bool:
        while element is not None and element is not place:
            element = element.parent
        return element is place

    return "\n".join(r.text for r in runs if inside(r.owner) and not only_links(r))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def work(batch: pa.RecordBatch, _) -> dict:
        texts = [extract(page) for page in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
