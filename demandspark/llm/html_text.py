"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Paragraphs give points for their length and commas,
times the part of their text that is not in links, to their parent, half to its parent,
and less further up. The container with the most points is kept with those of its siblings
that have text of their own; menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are no candidates and are left out inside it too. What only a
class or id names so is measured first: an element that holds the main element, the longest
article or most of the page's points is a wrapper and stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = set("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article main body html #root figcaption".split())
SKIPPED = set(
    "head nav header footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu title "
    "noembed noframes xmp audio video".split()
)
SKIPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
SKIPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu "
    "sidebar footer header masthead breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended widget pagination pager toolbar".split()
)
# what an open element of the first kind is closed by
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "p": BLOCKS - {"li", "td", "th", "tr", "dt", "dd", "option", "caption", "tbody", "thead", "tfoot"},
}
# elements nested deeper get no children, as in browsers; their text goes to the one around them
DEPTH = 512
_SCOPE = {"table", "ul", "ol", "dl", "body", "html", "td", "th", "article", "section", "div", "main", "select"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S)
# a name, and after = a value in quotes or up to white space or the end of the tag
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|((?![\"'])[^\s>]+|[\"'][^\s>]*)?))?")
_TAG_END = re.compile(r"[\s/]*(>|\Z)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONTAINERS = {"div", "section", "article", "main", "body", "html", "#root"}
# marks an element whose whole class or id is a skipped name; and the discount of named elements beside text in an article or main element
NAMED_PART = 0.25
# of an element whose name is of remarks: it is never opened, whatever it holds
REMARKS = -1.0
REMARK_NAMES = set("comment comments commentlist disqus reply replies respond".split())
# words that make a name one of what holds remarks beside the text
HOLDER_NAMES = set("with has no open closed enabled disabled allow allowed".split())


class Element:
    __slots__ = ("tag", "parent", "parts", "skipped", "points", "length", "linked", "depth", "named")

    def __init__(self, tag: str, parent: Element | None, skipped: bool = False, named: float = 0.0):
        self.tag, self.parent, self.parts, self.skipped, self.named = tag, parent, [], skipped or named != 0, named
        self.points, self.length, self.linked = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


Attributes = list[tuple[str, str]]


def _attributes(page: str, at: int) -> tuple[Attributes, int, bool]:
    """(name, value) of a tag's attributes from ``at`` on, where the tag ends, and whether it closes itself.

    As in browsers, an unquoted value ends at white space or >, quotes inside it are plain. A value
    whose quote never closes ends there, too; what is cut off at the end of the page is no tag.
    """
    found: Attributes = []
    while True:
        end = _TAG_END.match(page, at)
        if end:
            return found, end.end() if end[1] else -1, "/" in end[0]
        one = _ATTRIBUTE.match(page, at)
        if one is None:
            return found, -1, False
        value = one[2] if one[2] is not None else one[3] if one[3] is not None else one[4] or ""
        found.append((one[1].lower(), value))
        at = one.end()


def _is_skipped(tag: str, attributes: Attributes) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "role" and value.lower() in SKIPPED_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attributes: Attributes) -> float:
    """0 without a skipped name in class or id, REMARKS if one is of remarks, NAMED_PART if one is a whole class or id, else 1."""
    if not attributes or tag in ("html", "body", "main"):
        return 0.0
    found = 0.0
    for name, value in attributes:
        if name in ("class", "id"):
            for one in value.split():
                words = {one.lower()} | {x.lower() for x in _NAME.findall(one)}
                whole = one.lower() in SKIPPED_NAMES
                # remarks are never the main text, unless the name is that of what holds them beside it
                if words & REMARK_NAMES and not words & HOLDER_NAMES:
                    return REMARKS
                if whole and tag != "article":
                    found = NAMED_PART
                elif words & SKIPPED_NAMES and tag != "article" and not found:
                    found = 1.0
    return found


def parse(page: str) -> Element:
    """The element tree of a page; missing end tags are supplied, what is cut off at the end is dropped."""
    root = here = Element("#root", None)
    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        if token is None:
            at += 1
            continue
        at = token.end()
        tag, text = token[2], token[3]
        if text is not None:
            here.parts.append(html.unescape(text) if "&" in text else text)
        elif tag:
            tag = tag.lower()
            if token[1]:
                end = page.find(">", at)
                if end < 0:
                    break
                here, at = _closed(here, tag), end + 1
                continue
            here = _implied(here, tag)
            attributes, at, closes = _attributes(page, at)
            if at < 0:
                break
            skipped = _is_skipped(tag, attributes)
            new = Element(tag, here, skipped, 0.0 if skipped else _named(tag, attributes))
            here.parts.append(new)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            elif tag not in VOID and not closes and new.depth < DEPTH:
                here = new
    return root


def _closed(here: Element, tag: str) -> Element:
    x = here
    while x.parent is not None and x.tag != tag:
        # an inline end tag does not close the blocks around it
        if tag not in BLOCKS and x.tag in BLOCKS:
            return here
        x = x.parent
    return x.parent if x.parent is not None else here


def _implied(here: Element, tag: str) -> Element:
    x = here
    while x.parent is not None:
        if tag in _CLOSED_BY.get(x.tag, ()):
            here = x = x.parent
        elif x.tag in _SCOPE:
            return here
        else:
            x = x.parent
    return here


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements that are not skipped, each before and after what it holds."""
    stack: list[tuple[Element, bool]] = [(root, True)]
    while stack:
        x, enter = stack.pop()
        yield x, enter
        if enter:
            stack.append((x, False))
            stack.extend((p, True) for p in reversed(x.parts) if isinstance(p, Element) and not p.skipped)


def _paragraphs(root: Element) -> Iterator[tuple[Element, float]]:
    """Elements with text of their own and its points; gives all elements their lengths."""
    links = 0
    for x, enter in _walk(root):
        if x.tag == "a":
            links += 1 if enter else -1
        if enter:
            continue
        text = " ".join(p for p in x.parts if isinstance(p, str))
        x.length = len(text.strip())
        x.linked = x.length if links or x.tag == "a" else 0
        inline = [p for p in x.parts if isinstance(p, Element) and not p.skipped]
        for p in inline:
            x.length += p.length
            x.linked += p.linked
        if x.tag in PARAGRAPHS:
            # what this paragraph holds itself, without the blocks in it
            own = sum(p.length for p in inline if p.tag not in BLOCKS) + len(text.strip())
            linked = sum(p.linked for p in inline if p.tag not in BLOCKS)
            if own:
                commas = sum(y.count(",") + y.count("，") + y.count("、") for y in _inline_text(x))
                yield x, (min(own / 25, 1) + commas + min(own / 100, 3)) * (1 - linked / own)


def _open_wrappers(root: Element) -> None:
    """No longer skips what is skipped only by name and holds the page's main text."""
    named = []
    stack = [root]
    while stack:
        for p in stack.pop().parts:
            if isinstance(p, Element) and (p.named > 0 or not p.skipped):
                stack.append(p)
                if p.named > 0:
                    named.append(p)
    if not named:
        return
    for x in named:
        x.skipped = False
    own = dict(_paragraphs(root))
    # points of all an element holds, of the largest article in it, and whether it holds a main element with any
    held: dict[Element, tuple[float, float, bool]] = {}
    for x, enter in _walk(root):
        if not enter:
            inside = [held[p] for p in x.parts if isinstance(p, Element) and not p.skipped]
            total = own.get(x, 0.0) + sum(i[0] for i in inside)
            article = max([i[1] for i in inside] + [total if x.tag == "article" else 0.0])
            held[x] = total, article, any(i[2] for i in inside) or (x.tag == "main" and total > 0)
    for x in named:
        x.skipped = True
    outside, body = 0.0, False
    for x, enter in _walk(root):
        if enter and x in own:
            outside += own[x]
            body = body or _within(x, ("article", "main"))
    page = held[root][0]
    for x in named:
        total, article, main = held[x]
        # an article in an article is a comment on it
        longest = article > outside and not _within(x.parent, ("article",))
        # an element named so as a whole is opened for an article or main element only
        most = x.named == 1.0 and total * (NAMED_PART if body else 1) > page - total
        x.skipped = not (main or longest or most)
    if not outside and all(x.skipped for x in named):
        x = max(named, key=lambda x: held[x][0])
        while x is not None:
            x.skipped, x = False, x.parent


def _within(x: Element | None, tags: tuple[str, ...]) -> bool:
    while x is not None and x.tag not in tags:
        x = x.parent
    return x is not None


def _score(root: Element) -> Element | None:
    """Gives all elements their points; the container with the most, the outermost of equals."""
    best = None
    for x, points in _paragraphs(root):
        up, part = (x if x.tag in _CONTAINERS else x.parent), 1.0
        while up is not None and part > 0.05:
            up.points += points * part
            up, part = up.parent, part / 2
    for x, enter in _walk(root):
        if enter and x.points > 0 and (best is None or x.points * _own(x) > best.points * _own(best)):
            best = x
    return best


def _inline_text(x: Element) -> Iterator[str]:
    stack: list = [*x.parts]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            yield p
        elif not p.skipped and p.tag not in BLOCKS:
            stack.extend(p.parts)


def _own(x: Element) -> float:
    return 1 - x.linked / x.length if x.length else 1.0


def _kept(best: Element) -> list[Element]:
    """The best container, or the article around it, with its siblings that hold text."""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("body", "html", "main"):
        return [best]
    kept = []
    for x in best.parent.parts:
        if isinstance(x, str) or x.skipped:
            continue
        if best.tag == "article":
            fits = x.tag == "article" and x.points >= 0.2 * best.points
        else:
            fits = x.points * _own(x) >= 0.2 * best.points or (x.tag in PARAGRAPHS and x.length > 0 and x.linked < 0.33 * x.length)
        if x is best or fits:
            kept.append(x)
    return kept


def _blocks(root: Element) -> Iterator[str]:
    """The text between block borders, white space as one space."""
    held: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        border = x is None or x.tag in BLOCKS
        if border:
            block = " ".join("".join(held).split())
            held = []
            if block:
                yield block
        if x is None or x.skipped:
            continue
        if x.tag in ("br", "hr"):
            held.append(" ")
        if border:
            stack.append(None)
        stack.extend(reversed(x.parts))
    block = " ".join("".join(held).split())
    if block:
        yield block


def main_text(page: str | None) -> str:
    """Blocks of the main text of a whole page in order, one a line; empty if there are none."""
    if not page:
        return ""
    root = parse(page)
    _open_wrappers(root)
    best = _score(root)
    return "\n".join(b for x in _kept(best) for b in _blocks(x)) if best is not None else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null, empty or textless page gives an empty text.

    Other columns are ignored; repeated rows are returned as often as they come.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batches):
        for batch in batches:
            text = [main_text(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return in_batches(rows).mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
