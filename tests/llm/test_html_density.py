"""Density decides what the article is; an independent density; extraction as a query."""

import math
from html.parser import HTMLParser

import pytest

from tidemark.llm import htmltext
from tidemark.llm.htmltext import extract, main_text

PARAGRAPHS = [f"Paragraph {k} tells at some length how the old mill was mended after the flood of that year." * (k % 3 + 1) for k in range(6)]
ARTICLE = "<h1>The mill</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LINKS = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(12))


class Tree(HTMLParser):
    """A plain tree of well-formed html: [tag, children]."""

    def __init__(self, text):
        super().__init__()
        self.root = ["root", []]
        self.open = [self.root]
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in htmltext.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def counts(node, in_link=False):
    """(characters, tags, linked characters, link tags) below a node, by recursion."""
    in_link = in_link or node[0] == "a"
    c = t = lc = lt = 0
    for d in node[1]:
        if isinstance(d, str):
            n = len(d.replace(" ", "").replace("\n", ""))
            c, lc = c + n, lc + n * in_link
        else:
            a, b, e, f = counts(d, in_link)
            c, t, lc, lt = c + a, t + b + 1, lc + e, lt + f + (d[0] == "a")
    return c, t, lc, lt


def composite(node, body):
    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    bc, _, blc, _ = counts(body)
    t, lt, links, plain = max(1, t), max(1, lt), max(1, lc), max(1, c - lc)
    base = math.log(c / plain * lc + blc / max(1, bc) * c + math.e)
    return c / t * math.log(max(1.0, c / links * t / lt)) / base


def test_densities():
    page = f"<body><div><ul>{LINKS}</ul></div><div><div>{ARTICLE}</div><p>Tail <b>bold <i>text</i></b><br>end</p></div></body>"
    ours = htmltext.measure(next(d for d in htmltext.parse(page).down if not isinstance(d, str)))
    body = Tree(page).root[1][0]
    stack, theirs = [body], []
    while stack:
        x = stack.pop()
        theirs.append(x)
        stack.extend(d for d in reversed(x[1]) if not isinstance(d, str))
    assert [x.tag for x in ours] == [x[0] for x in theirs]
    for a, b in zip(ours, theirs, strict=True):
        assert a.density == pytest.approx(composite(b, body))
        assert a.total == pytest.approx(sum(composite(d, body) for d in b[1] if not isinstance(d, str)))


PLAIN = [
    f'<body><div class="x1"><ul>{LINKS}</ul></div><div class="x2">Short line.</div><div class="x3">{ARTICLE}</div><div class="x4">All rights with us</div></body>',
    f"<body><div><div><ul>{LINKS}</ul></div><div>{ARTICLE}</div></div><div>Offer of the day</div></body>",
]


@pytest.mark.parametrize("page", PLAIN)
def test_density_decides_where_nothing_is_named(page, monkeypatch):
    want = "\n\n".join(["The mill", *PARAGRAPHS])
    got = main_text(page)
    assert want in got
    assert "Section number" not in got
    assert "Offer" not in got
    assert "Short line" not in got
    monkeypatch.setattr(htmltext, "density", lambda *_: 1.0)
    assert main_text(page) != got


def test_density_outvotes_names():
    """A marked wrapper stays if the densest text is in it, unmarked menus go."""
    page = f'<body><div class="banner-layout">{ARTICLE}</div><div><ul>{LINKS}</ul></div></body>'
    assert main_text(page) == "\n\n".join(["The mill", *PARAGRAPHS])


@pytest.mark.parametrize("piece", ['<p class="share price">Share price fell 5 %.</p>', '<p class="tags">Tags were sewn on by hand.</p>', f'<div class="side"><p>{PARAGRAPHS[2]}</p></div>', '<h2 class="follow">What follows</h2>'])
def test_article_text_under_loose_names(piece):
    text = htmltext._BLANKS.sub(" ", htmltext._TAG.sub("", piece))
    assert text in main_text(f"<body><nav>{LINKS}</nav><article>{ARTICLE}{piece}</article></body>")


@pytest.mark.parametrize("chrome", ['<div class="share"><a href="#">Post it</a> <a href="#">Mail it</a></div>', '<p class="share"><a href="#">Post it</a></p>', '<aside><p>Elsewhere the harvest was good and nobody went hungry.</p></aside>', '<div class="comments"><p>First!</p></div>', '<div class="cookie-notice">This page keeps cookies for your comfort and ours.</div>', "<form><label>Name</label><input></form>"])
def test_chrome_inside_the_article(chrome):
    assert main_text(f"<body><main>{ARTICLE}{chrome}</main></body>") == "\n\n".join(["The mill", *PARAGRAPHS])


def test_title_before_the_core():
    assert main_text(f"<body><div><ul>{LINKS}</ul></div><h1>On mills</h1><div>{ARTICLE}</div></body>").startswith("On mills\n\nThe mill")


def test_short_pages_keep_every_block():
    assert main_text("<body><h1>T</h1><p>One.</p><p>A second, longer paragraph stands here.</p><p>x</p></body>") == "T\n\nOne.\n\nA second, longer paragraph stands here.\n\nx"
    assert main_text("no tags at all") == "no tags at all"
    assert main_text("<p>&lt;a&gt; &amp; &eacute;</p>") == "<a> & é"


def test_extract(spark):
    deep = "<div>" * 3000 + "<p>bottom of the page</p>"
    long = "<body><article>" + "".join(f"<p>{p} {k}</p>" for k in range(3000) for p in PARAGRAPHS[:1]) + "</article></body>"
    rows = [(1, "u", PLAIN[0]), (1, "u", PLAIN[0]), (None, None, PLAIN[1]), (2, "v", None), (3, "w", ""), (4, "x", "<script>var a</script>"), (5, "y", deep), (6, "z", long)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((repr((r.page_id, r.url)), r.text, r.n_chars) for r in got.collect())
    assert found == sorted((repr(r[:2]), main_text(r[2]), len(main_text(r[2]))) for r in rows)
    texts = {k: t for k, t, _ in found}
    assert texts["(2, 'v')"] == texts["(3, 'w')"] == texts["(4, 'x')"] == ""
    assert texts["(5, 'y')"] == "bottom of the page"
    assert texts["(6, 'z')"].count("\n\n") == 2999
    assert extract(pages.limit(0)).count() == 0
