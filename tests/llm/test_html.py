"""Page extraction on the synthetic pages and on pages of other builds."""

import html
import math
import re
import time

import pytest

from gistworks.llm import html_text, queries

SF = "/root/testdata/sf0.01"


def said(k):
    return f"The quick brown fox {k} jumps over the lazy dog, again and again, until it rains; then it stops."


def test_synthetic_pages(spark):
    """Their article, taken from the source by its tags."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.QUERIES["op8_html_extraction"](spark, SF).collect()
    assert len(found) == len(pages)
    for row in found:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[row.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h\d)>", article)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


PAGES = {
    "divs": (
        f"<html><body><div id=header><a href=/>Home</a> Site</div><div class='menu'><ul><li><a>One</a><li><a>Two</a></ul></div><div id=wrap><div id=content>"
        f"<h1>Title</h1><p>{said(1)}</p><p>Short.</p><p>{said(2)} <a href=x>link</a> tail.</p><ul><li>{said(3)}<li>item two</ul></div>"
        "<div id=sidebar><h3>Links</h3><p>Subscribe now to our paper.</p></div></div><div id=footer>Copyright by the owner of the site.</div></body></html>",
        ["Title", said(1), "Short.", said(2) + " link tail.", said(3), "item two"],
    ),
    "sections": (
        f"<body><div class=page><h1>Head</h1><div><h2>A</h2><p>{said(1)}<p>{said(2)}</div><p>x</p><div><h2>B</h2><p>{said(3)}<p>{said(4)}</div></div></body>",
        ["Head", "A", said(1), said(2), "x", "B", said(3), said(4)],
    ),
    "comments": (
        f"<body><header><h1>Site</h1></header><main><h1>Title</h1><div class=body><p>{said(1)}</p><p>{said(2)}</p></div>"
        f"<section class=comments><h2>Comments</h2><p>{said(7)}</p><p>{said(8)}</p></section></main><aside>{said(9)}</aside></body>",
        ["Title", said(1), said(2)],
    ),
    "article": (
        f"<body><article class='post has-sidebar'><header><h1>T</h1></header><p>{said(1)} &amp; &lt;b&gt; &eacute;&#233;</p><div class='share-buttons'>Share this</div>"
        f"<p>two\n  lines<br>here</p><footer>by me</footer><section id='comments'><p>{said(5)}</p></section></article><div class=cookie-notice><p>{said(6) * 3}</p></div>",
        ["T", said(1) + " & <b> éé", "two lines here"],
    ),
    "unclosed menu": (f"<body><nav><ul><li><a>x</a><article><p>{said(1)}</p></article>", [said(1)]),
    "script": ("<body><script>if (a<b) document.write('</p>');</script><p>Hi there</p><style>p{}</style><!-- <p>no</p> -->", ["Hi there"]),
    "form": (f"<body><div><p>{said(1)}</p><form><p>Your name</p><input></form><p>{said(2)}</p></div>", [said(1), said(2)]),
    "hidden": (f"<body><div><p>{said(1)}</p><p style='display: none'>gone</p><p hidden>gone</p><p>{said(2)}</p></div>", [said(1), said(2)]),
    "plain": ("just\n some   text", ["just some text"]),
    "attributes": ("<body><p class=x title='a>b'>a > b < c</p><!-- c --><p>d<!--", ["a > b < c", "d"]),
    "nothing": ("<body><nav>menu</nav><script>x</script></body>", []),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, blocks = PAGES[name]
    assert html_text.main_text(source) == "\n".join(blocks)


def test_very_long_and_deep_pages():
    assert html_text.main_text("<article>" + f"<p>{said(1)}</p>" * 20_000).count("\n") == 19_999
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html_text.main_text("<b>" * 30_000 + "text" + "<" * 1000) == "text" + "<" * 1000
    html_text.main_text('<p class="' * 20_000)
    html_text.main_text("<p a='" * 20_000 + ">")


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>a</p>", "x", 1), (1, "u", "<p>a</p>", "x", 1), (None, None, None, None, None)]
    found = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


WRAPPED = f"<div class=menu><a href=/>Home</a> All pages</div><h1>Title</h1><div><p>{said(1)}</p><p>{said(2)}</p></div><div class=sidebar>Buy now</div>"


@pytest.mark.parametrize(
    "begin, end",
    [
        ("<form id='aspnetForm'><label>Find</label><input name=q><button>Go</button>", "</form>"), ("<div id='wrapper' class='right-sidebar'>", "</div>"),
        ("<div id='top'>", "</div>"), ("<form><div id=top><div class='modal-open'>", "</div></div></form>"), ("<header>", "</header>"),
    ],
)
def test_wrappers_with_boilerplate_names(begin, end):
    assert html_text.main_text(f"<html><body>{begin}{WRAPPED}{end}<div id=footer>Copyright</div></body></html>") == "\n".join(["Title", said(1), said(2)])


def test_small_forms_comments_and_hidden_wrappers_still_go():
    text = f"<div><p>{said(1)}</p><p>{said(2)}</p></div>"
    assert html_text.main_text(f"<body>{text}<form><p>{said(3)}</p></form>") == said(1) + "\n" + said(2)
    assert html_text.main_text(f"<body>{text}<div class=comments>" + f"<p>{said(3)}</p>" * 5 + "</div>") == said(1) + "\n" + said(2)
    assert html_text.main_text(f"<body><form style='display:none'>{text}</form>") == ""
    html_text.main_text("<form><div class=nav>" * 30_000 + "deep")


@pytest.mark.parametrize(
    "source",
    ["<div>" * 20_000 + "</p>" * 20_000, "<span>" * 20_000 + "</em>" * 20_000, "<em><div>" + "<span>" * 20_000 + "</em>" * 20_000, "<div>" * 60_000 + "text " + "</p></em></td>" * 60_000],
)
def test_deep_pages_with_end_tags_take_time_in_proportion(source):
    start = time.perf_counter()
    html_text.main_text(source)
    assert time.perf_counter() - start < 4


@pytest.mark.parametrize(
    "inner, held",
    [
        ("<div class='widget-text'><p>{0}</p></div>", True), ("<p>{1}</p><section class='social-impact'><p>{0}</p></section>", True), ("<p>{1}</p><p class='share-price'>{0}</p>", True),
        ("<p>{1}</p><p class='comment-on-law'>{0}</p>", True), ("<p>{1}</p><div class='comment-list'><p>{0}</p></div>", False), ("<p>{1}</p><div class='share-buttons'>{0}</div>", False),
        ("<p>{1}</p><div class='related'>{0}</div>", False), ("<p>{1}</p><div class='promo-2'>{0}</div>", False),
    ],
)
def test_names_inside_an_article_go_by_their_last_word(inner, held):
    text = html_text.main_text(f"<body><article><h1>Title</h1>{inner.format(said(1), said(2))}</article></body>")
    assert (said(1) in text) == held and "Title" in text


def test_densities_by_recursion():
    """Composite text density as published, over the whole subtree of each block."""
    source = f"<body><div><p>{said(1)}</p><p>{said(2)} <a href=x>some link</a></p></div><ul><li><a>One</a></li><li><a>Two</a> x</li></ul><div><em>{said(3)}</em></div></body>"
    page = html_text._tree(source)
    density, sums = html_text._densities(page)

    def figures(node):
        chars = tags = link_chars = link_tags = 0
        for part in page.content[node]:
            if isinstance(part, str):
                chars += len(part.strip())
            else:
                c, t, lc, lt = figures(part)
                link = page.tags[part] == "a"
                chars, tags = chars + c, tags + t + (link or page.tags[part] in html_text.BLOCKS)
                link_chars, link_tags = link_chars + (c if link else lc), link_tags + (t if link else lt) + link
        return chars, tags, link_chars, link_tags

    whole_chars, _, whole_links, _ = figures(0)
    for node, tag in enumerate(page.tags):
        if tag not in html_text.BLOCKS:
            continue
        c, t, lc, lt = figures(node)
        base = math.log(c / max(c - lc, 1) * lc + whole_links / whole_chars * c + math.e)
        want = c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / math.log(base + 1)
        assert density[node] == pytest.approx(want)
    top = [n for n, parent in enumerate(page.parents) if parent == 0]
    assert sums[0] == pytest.approx(sum(density[n] for n in top))
