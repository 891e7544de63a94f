"""Names and forms don't cut the article."""

import pytest

from tidemark.llm.htmltext import NAMES, READERS, main_text

PROSE = "The river rose over night, and nobody in the town had slept before the water fell again. " * 6
MENU = '<div class="nav"><a href="/">Home</a> <a href="/a">About us</a></div>'


@pytest.mark.parametrize("wrap", ['<div class="content with-sidebar">{}</div>', '<div class="post share-enabled">{}</div>', "<form>{}<input name=q><button>Send</button></form>"])
def test_wrappers(wrap):
    text = main_text("<body>" + wrap.format(f"<p>{PROSE}</p>") + MENU + '<div class="sidebar">Weather and adverts</div></body>')
    assert text == PROSE.strip()


def test_headings_and_paragraphs():
    page = f'<body>{MENU}<article><h2 id="search-engines">Engines</h2><p>{PROSE}</p><h2 id="related-work">Related</h2><p class="notice-text">{PROSE}</p><p class="ad">Buy</p></article></body>'
    assert main_text(page) == f"Engines\n\n{PROSE.strip()}\n\nRelated\n\n{PROSE.strip()}"


def test_longer_comments_are_cut():
    assert main_text(f'<body><article><p>{PROSE}</p></article><div id="comments"><p>{PROSE}</p><p>{PROSE}</p></div></body>') == PROSE.strip()


SHORT = "At noon the ferry went out with nine people and a goat, and it came back with ten."


@pytest.mark.parametrize("tag", ["section", "div"])
@pytest.mark.parametrize("slug", ["{}-at-sea", "on-the-{}", "a-{}-for-two", "{}Making", "of_{}s"])
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_slugs_keep_their_sections(tag, slug, attribute):
    for name in sorted(NAMES):
        page = f'<body>{MENU}<article><h1>T</h1><p>{PROSE}</p><{tag} {attribute}="{slug.format(name)}"><h2>Of it</h2><p>{SHORT}</p></{tag}><p>{PROSE}</p></article></body>'
        assert main_text(page) == f"T\n\n{PROSE.strip()}\n\nOf it\n\n{SHORT}\n\n{PROSE.strip()}", name


@pytest.mark.parametrize("name", sorted(NAMES - READERS))
def test_sections_named_by_their_heading(name):
    page = f'<body>{MENU}<article><h1>T</h1><p>{PROSE}</p><section id="{name}"><h2>{name.title()}</h2><p>{PROSE}</p></section></article></body>'
    assert main_text(page) == f"T\n\n{PROSE.strip()}\n\n{name.title()}\n\n{PROSE.strip()}"


@pytest.mark.parametrize("name", ["cookie-notice", "site-footer", "ad", "ad-slot-2", "left-sidebar", "post-comments", "relatedPosts", "comment-list", "share-buttons", "main-nav", "newsletter-box"])
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_whole_names_cut(name, attribute):
    links = '<a href="/x">One</a> <a href="/y">Another</a>' if "share" in name or "nav" in name else "Plain words that belong to no article at all."
    assert main_text(f'<body>{MENU}<article><p>{PROSE}</p><div {attribute}="{name}">{links}</div></article></body>') == PROSE.strip()


def test_slugs_of_links_cut():
    page = f'<body><article><p>{PROSE}</p><div class="acme-nav-drawer"><a href="/x">One</a> <a href="/y">Another</a></div></article></body>'
    assert main_text(page) == PROSE.strip()
