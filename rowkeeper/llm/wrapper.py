"""Main text of pages by wrapper induction.

The pages of a host are filled from a few templates. A page's elements are put into slots: an element, or a run of like siblings
such as the paragraphs of an article. The slot trees of a host's pages are aligned one after the other by simple tree matching
(the largest number of pairs of equal labels that keeps order and parents), which gives the host's wrapper: every slot
with the number of pages that have it, how much of its text is in links, and whether its text is the same on all of them. Constant
slots are template; of the varying ones those are content that lie in the article and are no menu, notice, advert and the like.

Wrappers are induced in Spark by partial aggregation: each task aligns the pages that it reads, and partial wrappers of a host, a few
kilobytes each, are aligned with one another, first in groups. So every page takes part and no task sees a whole host. Then
pages meet their host's wrapper in a join and are read once more.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeeper.llm.common import rows_of
from rowkeeper.llm.dom import INLINE, Page, attributes_of, read_page
from rowkeeper.llm.language import page_host
from rowkeeper.session import written

CONSTANT_PAGES = 8  # different pages that show the same text before it counts as template
LINKED = 0.6  # share of a slot's text in links above which it is a menu
MOST_DEPTH = 40  # of slots; elements below belong to the slot at this depth
MOST_SIBLINGS = 48  # slots side by side; beyond, like elements share a slot wherever they stand
HELD_SLOTS = 200_000  # of all wrappers in a task, before they are handed on
SALTS = 32  # groups in which partial wrappers of a host are aligned first

# Elements and words that name what is not main text: fixed values.
LEFT_OUT_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input svg math canvas iframe object audio video "
    "dialog menu title xmp noembed noframes datalist".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar aside nav "
    "navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login comment comments commentlist respond "
    "disqus discussion replies pagination pager toolbar skip toc alert".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))
COMMENT_WORDS = frozenset(("comment", "comments", "reply"))
NOT, MAYBE, SURE = range(3)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=50_000)
def described(tag: str, attributes: str) -> tuple[str, int, bool, str]:
    """Label of an element; whether it is left out (MAYBE: unless it holds an article); whether it is a header; its role."""
    found = attributes_of(attributes) if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    label = tag
    kinds = sorted({re.sub(r"\d+", "", word) for word in names.split()} - {""})
    if kinds:
        label = f"{tag}.{'.'.join(kinds)}"
    role = found.get("role", "").strip().lower()
    words = {w.lower() for w in WORDS.findall(names)}
    out, header = NOT, tag == "header"
    if tag not in INLINE and tag not in ("html", "body", "main", "pre"):
        # An article's names tell its subjects too.
        named = COMMENT_WORDS if tag == "article" else LEFT_OUT_WORDS
        out = MAYBE if words & named else NOT
        header = header or bool(words & HEADER_WORDS)
    if tag in LEFT_OUT_TAGS or role in LEFT_OUT_ROLES or found.get("aria-hidden") == "true":
        out = SURE
    return label, out, header, role


class Slots:
    """The slot tree of a page: labels and parents of its slots in page order, the slot of each element, and the tree as text."""

    def __init__(self, page: Page):
        self.labels, self.above, self.kids = ["#"], [-1], [[]]
        n = len(page.tags)
        self.of = [0] * n
        blocks: list[list[int]] = [[] for _ in range(n)]
        owner = [0] * n
        label = [""] * n
        for i in range(1, n):
            parent = owner[page.parents[i]]
            tag = page.tags[i]
            if tag in INLINE:
                owner[i] = parent
                continue
            owner[i] = i
            label[i] = described(tag, page.attributes[i])[0]
            blocks[parent].append(i)
        # What tells like siblings: the labels of their children, runs counted once.
        shallow: list[tuple] = [()] * n
        for i in range(n):
            runs = []
            for child in blocks[i]:
                if not runs or runs[-1] != label[child]:
                    runs.append(label[child])
            shallow[i] = tuple(runs)
        todo = [(0, [0], 0)]
        shapes: dict[int, int] = {}
        while todo:
            slot, members, depth = todo.pop()
            for i in members:
                self.of[i] = slot
            if depth == MOST_DEPTH:
                continue
            for group in _groups([blocks[i] for i in members], label, shallow):
                self.labels.append(label[group[0]])
                self.above.append(slot)
                self.kids.append([])
                self.kids[slot].append(len(self.labels) - 1)
                todo.append((len(self.labels) - 1, group, depth + 1))
        # An element without a slot of its own (inline or too deep) is in its parent's.
        for i in range(1, n):
            if owner[i] != i or self.of[i] == 0:
                self.of[i] = self.of[page.parents[i]]
        self.shape = repr((self.labels, self.above))


def _groups(lists: list[list[int]], label: list[str], shallow: list[tuple]) -> list[list[int]]:
    """The children of like elements as groups that become slots."""
    if not any(lists):
        return []
    if len(lists) == 1:
        runs: list[list[int]] = []
        for child in lists[0]:
            if runs and (label[runs[-1][0]], shallow[runs[-1][0]]) == (label[child], shallow[child]):
                runs[-1].append(child)
            else:
                runs.append([child])
        if len(runs) <= MOST_SIBLINGS:
            return runs
    by_label: dict[str, list[int]] = {}
    for children in lists:
        for child in children:
            name = label[child]
            if name not in by_label and len(by_label) >= MOST_SIBLINGS:
                name = next(iter(by_label))
            by_label.setdefault(name, []).append(child)
    return list(by_label.values())


class Node:
    """A slot of a wrapper."""

    __slots__ = ("label", "kids", "pages", "text", "chars", "linked", "different")

    def __init__(self, label: str):
        self.label, self.kids = label, []
        self.pages = self.chars = self.linked = 0
        self.text: int | None = None  # hash of the text, 0 once it varies
        self.different: list[int] = []  # marks of different pages that have the slot, up to CONSTANT_PAGES

    def add(self, pages: int, text: int, chars: int, linked: int, different) -> None:
        self.pages += pages
        self.chars += chars
        self.linked += linked
        self.text = text if self.text is None or self.text == text else 0
        if len(self.different) < CONSTANT_PAGES:
            self.different = sorted({*self.different, *different})[:CONSTANT_PAGES]

    def packed(self) -> list:
        return [self.label, self.pages, self.text or 0, self.chars, self.linked, self.different, [k.packed() for k in self.kids]]


class Tree:
    """What is aligned with a wrapper: labels and children by number, the root is 0."""

    def __init__(self, labels, kids):
        self.labels, self.kids = labels, kids


def matched(node: Node, tree, at: int, known: dict) -> int:
    """Simple tree matching: the most pairs of equal labels below two roots of equal labels, in order; keeps its tables in ``known``."""
    key = (id(node), at)
    if key in known:
        return known[key][0]
    left, right = node.kids, tree.kids[at]
    rows = [[0] * (len(right) + 1)]
    weights = []
    for a in left:
        above, row, w = rows[-1], [0], []
        for j, b in enumerate(right):
            pair = matched(a, tree, b, known) if a.label == tree.labels[b] else 0
            w.append(pair)
            row.append(max(row[-1], above[j + 1], above[j] + pair))
        weights.append(w)
        rows.append(row)
    known[key] = (rows[-1][-1] + 1, rows, weights)
    return known[key][0]


def aligned(root: Node, tree) -> list[Node]:
    """The wrapper's slot for each slot of the tree; slots that the wrapper lacks are put in at their place."""
    known: dict = {}
    matched(root, tree, 0, known)
    found: list = [None] * len(tree.labels)
    todo = [(root, 0)]
    while todo:
        node, at = todo.pop()
        found[at] = node
        right = tree.kids[at]
        pairs = {}
        if (id(node), at) in known:
            _, rows, weights = known[(id(node), at)]
            i, j = len(node.kids), len(right)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs[j] = node.kids[i]
        place = 0
        for j, b in enumerate(right):
            if j in pairs:
                place = node.kids.index(pairs[j]) + 1
            else:
                pairs[j] = Node(tree.labels[b])
                node.kids.insert(place, pairs[j])
                place += 1
            todo.append((pairs[j], b))
    return found


def size_of(root: Node) -> int:
    todo, n = [root], 0
    while todo:
        n += 1
        todo += todo.pop().kids
    return n


class Unpacked:
    """A packed partial wrapper as a tree to align, with its figures by slot."""

    def __init__(self, packed: list):
        self.labels, self.kids, self.figures = [], [], []
        todo = [(packed, -1)]
        for (label, *figures, kids), above in todo:
            self.labels.append(label)
            self.kids.append([])
            self.figures.append(figures)
            if above >= 0:
                self.kids[above].append(len(self.labels) - 1)
            todo += [(kid, len(self.labels) - 1) for kid in kids]


def slot_texts(page: Page, slots: Slots) -> tuple[list[list[str]], list[int], list[int]]:
    """Text of each slot in pieces, its characters, and those of them in links."""
    texts: list[list[str]] = [[] for _ in slots.labels]
    chars, linked = [0] * len(slots.labels), [0] * len(slots.labels)
    in_link = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        in_link[i] = page.tags[i] == "a" or in_link[page.parents[i]]
    for element, _, text in page.pieces:
        bare = " ".join(text.split())
        if bare:
            slot = slots.of[element]
            texts[slot].append(bare)
            chars[slot] += len(bare)
            linked[slot] += len(bare) if in_link[element] else 0
    return texts, chars, linked


class Induction:
    """Wrappers of the hosts whose pages a task reads."""

    def __init__(self):
        self.wrappers: dict[str, Node] = {}
        self.found: dict[tuple[str, str], list[Node]] = {}
        self.slots = 0

    def page(self, host: str, source: str) -> None:
        page = read_page(source)
        slots = Slots(page)
        texts, chars, linked = slot_texts(page, slots)
        key = (host, slots.shape)
        if key not in self.found:
            if host not in self.wrappers:
                self.wrappers[host] = Node("#")
            self.found[key] = aligned(self.wrappers[host], slots)
            self.slots += len(slots.labels)
        hashes = [xxhash.xxh3_64_intdigest("\n".join(t)) >> 1 or 1 for t in texts]
        mark = xxhash.xxh3_64_intdigest(repr(hashes)) >> 1
        for node, text, n, in_links in zip(self.found[key], hashes, chars, linked):
            node.add(1, text, n, in_links, (mark,))

    def merge(self, host: str, packed: str) -> None:
        other = Unpacked(json.loads(packed))
        if host not in self.wrappers:
            self.wrappers[host] = Node("#")
        for node, (pages, text, chars, linked, different) in zip(aligned(self.wrappers[host], other), other.figures):
            node.add(pages, text, chars, linked, different)

    def packed(self) -> Iterator[tuple[str, str]]:
        for host, root in self.wrappers.items():
            yield host, json.dumps(root.packed(), ensure_ascii=False, separators=(",", ":"))


PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def _partial(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], schema=PARTIAL)


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of the hosts in one partition of pages."""
    state = Induction()
    for hosts, sources in rows_of(batches, "host", "html"):
        for host, source in zip(hosts, sources):
            state.page(host, source)
            if state.slots > HELD_SLOTS:
                yield _partial(state.packed())
                state = Induction()
    if state.wrappers:
        yield _partial(state.packed())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers that come sorted by host, aligned with one another."""
    held, state = None, Induction()
    for hosts, wrappers in rows_of(batches, "host", "wrapper"):
        for host, wrapper in zip(hosts, wrappers):
            if host != held:
                if held is not None:
                    yield _partial(state.packed())
                held, state = host, Induction()
            state.merge(host, wrapper)
    if held is not None:
        yield _partial(state.packed())


def _judged(packed: str) -> str:
    """A wrapper with a mark per slot instead of its figures: 1 template, 2 mostly links, 3 both."""
    tree = Unpacked(json.loads(packed))
    n = len(tree.labels)
    chars = [f[2] for f in tree.figures]
    linked = [f[3] for f in tree.figures]
    for i in reversed(range(n)):
        for kid in tree.kids[i]:
            chars[i] += chars[kid]
            linked[i] += linked[kid]
    marks = []
    for i in range(n):
        _, text, own, _, different = tree.figures[i]
        constant = text != 0 and own > 0 and len(different) >= CONSTANT_PAGES
        marks.append(int(constant) + 2 * (chars[i] > 0 and linked[i] > LINKED * chars[i]))

    packed_slots: list = [None] * n
    for i in reversed(range(n)):
        packed_slots[i] = [tree.labels[i], marks[i], [packed_slots[k] for k in tree.kids[i]]]
    return json.dumps(packed_slots[0], ensure_ascii=False, separators=(",", ":"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hosts, wrappers in rows_of(batches, "host", "wrapper"):
        yield _partial(zip(hosts, map(_judged, wrappers)))


def induced_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` from all rows of ``pages`` (``host``, ``html``), none of them null.

    Hosts whose name no page has in common with another cost nothing beyond their own pages. Partial wrappers are merged in
    SALTS groups first, so a hot host is spread, and they come in the order of their text, so a rerun gives the same.
    """
    schema = "host string, wrapper string"
    partial = pages.mapInArrow(_induce, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    grouped = partial.repartition("host", "salt").sortWithinPartitions("host", "wrapper").select("host", "wrapper").mapInArrow(_merge, schema)
    whole = grouped.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, schema)
    return whole.mapInArrow(_judge, schema)


class Extraction:
    """Main text of pages by the wrappers of their hosts."""

    HELD = 20_000  # alignments that a worker keeps

    def __init__(self):
        self.marks: dict[tuple[str, str], list[int]] = {}

    def _marks_of(self, wrapper: str | None, slots: Slots) -> list[int]:
        if wrapper is None:
            return [0] * len(slots.labels)
        key = (wrapper, slots.shape)
        if key not in self.marks:
            if len(self.marks) >= self.HELD:
                self.marks.clear()
            marks: dict[int, int] = {}

            def built(packed: list) -> Node:
                node = Node(packed[0])
                marks[id(node)] = packed[1]
                node.kids = [built(kid) for kid in packed[2]]
                return node

            root = built(json.loads(wrapper))
            self.marks[key] = [marks.get(id(node), 0) for node in aligned(root, slots)]
        return self.marks[key]

    def text(self, source: str | None, wrapper: str | None) -> str:
        if not source:
            return ""
        page = read_page(source)
        slots = Slots(page)
        marks = self._marks_of(wrapper, slots)
        n = len(page.tags)
        about = [described(tag, attributes) for tag, attributes in zip(page.tags, page.attributes)]
        kinds = ["article" if "article" in (tag, a[3]) else "main" if "main" in (tag, a[3]) else "" for tag, a in zip(page.tags, about)]
        # What holds an article is not left out for its name alone.
        holds = [bool(kind) and a[1] == NOT for kind, a in zip(kinds, about)]
        for i in reversed(range(1, n)):
            holds[page.parents[i]] = holds[page.parents[i]] or holds[i]
        out, header, article = [False] * n, [False] * n, [False] * n
        tops: dict[str, list[int]] = {"article": [], "main": []}
        for i in range(1, n):
            parent = page.parents[i]
            out[i] = out[parent] or about[i][1] == SURE or (about[i][1] == MAYBE and not holds[i])
            header[i] = header[parent] or about[i][2]
            article[i] = article[parent] or (kinds[i] == "article" and not out[i])
            if kinds[i] and not out[i] and not article[parent]:
                tops[kinds[i]].append(i)
        # Constant text is template where it stands; what varies inside the same element is not.
        template = [bool(marks[slot] & 1) for slot in slots.of]
        chars = [0] * n
        for element, _, text in page.pieces:
            if not (out[element] or template[element]):
                chars[element] += len(text)
        for i in reversed(range(1, n)):
            chars[page.parents[i]] += chars[i]
        roots = self._roots(page, slots, marks, tops, chars, out, header, template)
        within = [False] * n
        for i in range(n):
            within[i] = i in roots or (i > 0 and within[page.parents[i]])
        inside_article = any(kinds[i] for i in roots)
        lines, block, held = [], None, []
        for element, number, text in page.pieces:
            if not within[element] or out[element] or template[element] or (header[element] and not inside_article):
                continue
            if number != block and held:
                lines.append("".join(held))
                held = []
            block = number
            held.append(text)
        lines.append("".join(held))
        return "\n".join(filter(None, (" ".join(line.split()) for line in lines)))

    @staticmethod
    def _roots(page, slots, marks, tops, chars, out, header, template) -> set[int]:
        """The elements that hold the main text: the largest article and its like, else the largest main, else what holds most text."""
        for kind in ("article", "main"):
            found = [i for i in tops[kind] if chars[i] > 0]
            if found:
                largest = max(found, key=lambda i: (chars[i], -i))
                label = slots.labels[slots.of[largest]]
                return {i for i in found if slots.labels[slots.of[i]] == label} if kind == "article" else {largest}
        # Text outside menus, by element; then down to the smallest element that holds nearly all of it.
        n = len(page.tags)
        useful, kids = [0] * n, [[] for _ in range(n)]
        menu = [False] * n
        for i in range(1, n):
            kids[page.parents[i]].append(i)
            menu[i] = menu[page.parents[i]] or (page.tags[i] not in INLINE and bool(marks[slots.of[i]] & 2))
        for element, _, text in page.pieces:
            if not (out[element] or header[element] or menu[element] or template[element]):
                useful[element] += len(text.strip())
        for i in reversed(range(1, n)):
            useful[page.parents[i]] += useful[i]
        at = 0
        while True:
            inner = [i for i in kids[at] if page.tags[i] not in INLINE and page.tags[i] != "p" and useful[i] >= 0.7 * useful[at] > 0]
            if not inner or not kids[inner[0]]:
                break
            at = inner[0]
        for i in range(1, n):
            out[i] = out[i] or menu[i]
        return {at}


def page_texts(pages: DataFrame) -> DataFrame:
    """Main text of each page: ``page_id``, ``url``, ``text`` and ``n_chars``, its code points; one row per row.

    Blocks come in page order, one a line, with white space (as Unicode has it) inside a block as one space. A page of null
    or without main text has an empty text. A url of null or without a host has no wrapper, so only names and elements
    decide there. Repeated rows count as one page for the wrapper and each get their text. An empty table gives no rows.
    Other columns are not read. A host with fewer than CONSTANT_PAGES different pages has no constant slots.
    """
    named = pages.select("page_id", "url", "html", F.nullif(page_host(F.col("url").cast("string")), F.lit("")).alias("host"))
    wrappers = written(induced_wrappers(named.filter(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html")), "wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Extraction()
        for batch in batches:
            texts = [
                state.text(source, wrapper)
                for sources, wrappers_of in rows_of([batch], "html", "wrapper") for source, wrapper in zip(sources, wrappers_of)
            ]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    joined = named.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
