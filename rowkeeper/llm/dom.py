"""A small reader of HTML: elements in page order with their parents, and the pieces of text between the tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DECODED_RAW = frozenset(("textarea", "title"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output picture q rb rp rt rtc ruby s samp "
    "slot small source span strike strong sub sup time tt u var wbr".split()
)
# These stand in a line of text without ending it, though blocks may be inside.
EMBEDDED = frozenset(
    "script style template noscript title button select textarea input label svg math canvas iframe object audio video datalist meter progress "
    "img link meta".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
BARRIERS = frozenset("button caption html object table td template th".split())
# An open element of the first kind ends when one of the second kind starts, up to an element of the third kind.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAMED = ("class", "id", "role", "hidden", "aria-hidden")


@dataclass
class Page:
    """Elements by number (0 is the page itself), and pieces of text as (element, block, text).

    Pieces of one block belong to one line of text: a block ends where an element that is not inline starts or ends.
    """

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        name = name.lower()
        if name in NAMED:
            found.setdefault(name, html.unescape(double or single or bare))
    return found


def read_page(source: str) -> Page:
    """Read a page leniently: unclosed elements end where the standard ends them, stray end tags are skipped."""
    page = Page()
    tags, parents, attributes, pieces = page.tags, page.parents, page.attributes, page.pieces
    stack, block, at, end = [0], 0, 0, len(source)
    # Open elements by tag, so that an end tag without a start costs nothing.
    open_tags: dict[str, int] = {}

    def pop_to(position: int) -> None:
        for i in stack[position:]:
            open_tags[tags[i]] -= 1
        del stack[position:]

    def close(which, barriers) -> None:
        """End the outermost open element of these tags above the nearest barrier."""
        if not any(open_tags.get(t) for t in which):
            return
        position = None
        for k in range(len(stack) - 1, 0, -1):
            tag = tags[stack[k]]
            if tag in barriers:
                break
            if tag in which:
                position = k
        if position is not None:
            pop_to(position)

    while at < end:
        token = TOKEN.search(source, at)
        start = token.start() if token else end
        if start > at:
            text = source[at:start]
            pieces.append((stack[-1], block, html.unescape(text) if "&" in text else text))
        if token is None:
            break
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        inline, breaks = tag in INLINE, not (tag in INLINE or tag in EMBEDDED)
        if token.group(1):
            if tag == "br":
                pieces.append((stack[-1], block, " "))
            elif open_tags.get(tag):
                position = len(stack) - 1
                while tags[stack[position]] != tag:
                    position -= 1
                # An inline end tag does not end the blocks around it.
                if not inline or all(tags[i] in INLINE for i in stack[position:]):
                    pop_to(position)
                    block += breaks
            elif tag == "p":
                block += 1
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            close(("p",), BARRIERS)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        tags.append(tag)
        parents.append(stack[-1])
        attributes.append(token.group(3) if "=" in token.group(3) else "")
        number = len(tags) - 1
        block += breaks
        if tag == "br":
            pieces.append((stack[-1], block, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            finish = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
            text = source[at:finish.start() if finish else end]
            pieces.append((number, block, html.unescape(text) if tag in DECODED_RAW else text))
            at = end
            if finish:
                closing = source.find(">", finish.end())
                at = end if closing < 0 else closing + 1
            block += breaks
            continue
        stack.append(number)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return page
