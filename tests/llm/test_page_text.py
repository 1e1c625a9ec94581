"""Main text of pages: the given pages against a plain reading of their article, and hand-made hosts."""

from __future__ import annotations

import html
import re
from itertools import product

import pytest

from rowkeeper.llm import wrapper
from rowkeeper.llm.dom import read_page
from rowkeeper.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


def plain_article(source):
    """The given pages have one article of headings and paragraphs, in which only ``b`` and ``br`` stand."""
    article = source[source.index("<article>") + 9:source.index("</article>")]
    blocks = [html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", part))) for part in re.split("</?(?:p|h1)>", article)]
    return "\n".join(filter(None, (" ".join(block.split()) for block in blocks)))


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in wrapper.page_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    expected = {r.page_id: (r.url, plain_article(r.html)) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op11_page_text"](spark, folder).collect()
    assert {r.page_id: (r.url, r.text) for r in found} == expected
    assert all(r.n_chars == len(r.text) for r in found)


def blog(i, extra=""):
    """A page without an article element; its notice, byline and closing line are the same on all pages of the host."""
    return f"""<html><head><title>T{i}</title><script>if (a<b) x("<p>no</p>")</script></head><body><div class=top><a href=/>Home</a>
      <a href=/n>News {i}</a> <a href=/m>More of {i}</a></div><div><p>Welcome to this blog</p><h2>Title {i}</h2>
      <p>First line of {i} &amp; its <i>own</i><br>words.<p>Second line of {i}, which is long enough to be told apart.{extra}</div>
      <div>All rights of this blog are reserved</div></body></html>"""


def test_constant_slots_are_template(spark):
    rows = [(i, "http://blog.example.com/x", blog(i)) for i in range(20)]
    found = texts(spark, rows)
    for i in range(20):
        assert found[i] == f"Title {i}\nFirst line of {i} & its own words.\nSecond line of {i}, which is long enough to be told apart."


def test_a_single_page_keeps_what_might_be_constant(spark):
    assert "Welcome to this blog" in texts(spark, [(1, "http://one.example.com/", blog(1))])[1]
    copies = [(i, "http://one.example.com/", blog(1)) for i in range(30)]
    assert "Welcome to this blog" in texts(spark, copies)[7]


def test_names_and_elements_that_are_left_out(spark):
    page = """<body><header class="site-header"><h1>Site</h1></header><div class="content-sidebar-wrap"><main><article class="post category-social">
      <header><h1>The title</h1></header><p>One.</p><div class="ad-slot">Buy</div><aside>Aside</aside><p>Two<script>x</script> and
      <code>code &lt;b&gt;</code>.</p><form><p>Mail</p></form><ul><li>First<li>Second</ul><table><tr><td>A<td>B</table>Loose</article>
      <section id="comments"><article class="comment"><p>I am a long comment of a reader, longer than all the rest of the page together,
      as some readers write and write and write.</p></article></section></main></div><div role="contentinfo">End</div></body>"""
    assert texts(spark, [(1, None, page)])[1].split("\n") == [
        "The title", "One.", "Two and code <b>.", "First", "Second", "A", "B", "Loose"
    ]


def test_partial_wrappers_agree_with_one_pass(spark, monkeypatch):
    """However the pages are dealt over tasks and groups, the wrapper marks the same slots."""
    shapes = [blog(i, "<ul><li>x</ul>" * (i % 2)) for i in range(24)]
    whole = wrapper.Induction()
    for source in shapes:
        whole.page("h", source)
    parts = []
    for k in range(5):
        part = wrapper.Induction()
        for source in shapes[k::5]:
            part.page("h", source)
        parts += [packed for _, packed in part.packed()]
    merged = wrapper.Induction()
    for packed in parts:
        merged.merge("h", packed)
    marks = [wrapper._judged(next(w.packed())[1]) for w in (whole, merged)]
    assert marks[0] == marks[1] and "1" in marks[0]


def plain_matching(a, b):
    """Simple tree matching by trying all ways to pair children in order."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), plain_matching(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def test_tree_matching():
    leaves = [("p", ()), ("d", ()), ("d", (("p", ()), ("i", ()))), ("d", (("i", ()), ("p", ()), ("p", ())))]
    trees = [("r", kids) for kids in product(leaves, repeat=2)] + [("r", kids) for kids in product(leaves, repeat=3)][:20]

    def node(tree):
        made = wrapper.Node(tree[0])
        made.kids = [node(k) for k in tree[1]]
        return made

    def flat(tree):
        labels, kids, todo = [], [], [(tree, -1)]
        for (label, below), above in todo:
            labels.append(label)
            kids.append([])
            if above >= 0:
                kids[above].append(len(labels) - 1)
            todo += [(k, len(labels) - 1) for k in below]
        return wrapper.Tree(labels, kids)

    for a, b in product(trees, trees):
        root, tree = node(a), flat(b)
        paired = wrapper.matched(root, tree, 0, {})
        assert paired == plain_matching(a, b)
        before = wrapper.size_of(root)
        wrapper.aligned(root, tree)
        assert wrapper.size_of(root) == before + len(tree.labels) - paired


@pytest.mark.parametrize("source", [
    "", "<", "<p", "<a href=\"x", "</p></div>", "<!--", "<!-->x", "<script>", "<title>&lt;</title", "<p>" * 5_000 + "x", "<div>" * 5_000 + "deep",
    "<b><p>a</b>b</p>", "&am &amp &#x41; &bogus;", "".join(f"<t{i}>{i}" for i in range(300)), "\ud800 x".encode("utf-8", "replace").decode(),
])
def test_broken_pages(source):
    page = read_page(source)
    assert len(page.tags) == len(page.parents) == len(page.attributes)
    assert all(p < i for i, p in enumerate(page.parents))
    state = wrapper.Induction()
    state.page("h", source)
    packed = wrapper._judged(next(state.packed())[1])
    assert isinstance(wrapper.Extraction().text(source, packed), str)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns with clashing names."""
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(None, None, None), (1, None, "<article>a &amp; b</article>"), (2, "http://x.example.com/", None), (2, "http://x.example.com/", None),
            (3, "no url", ""), (4, "http://x.example.com/", long), (4, "http://x.example.com/", long), (5, "http://X.example.com:80/", "<p>one")]
    table = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], SCHEMA + ", text string, host string, wrapper int")
    table.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op11_page_text"](spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect())
    words = "\n".join(["word"] * 50_000)
    assert got == [(0, "", 0), (1, "a & b", 5), (2, "", 0), (2, "", 0), (3, "", 0), (4, words, len(words)), (4, words, len(words)), (5, "one", 3)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op11_page_text"](spark, str(tmp_path)).count() == 0
