"""Codings, readers and extraction without Spark."""

import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import htmltext, induced, simple8b, warc
from tidemark.llm.zipranges import BadPackage, ZipRanges

ids = st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(ids, max_size=300), st.integers(0, 6))
def test_simple8b_round_trip(values, repeat):
    a = np.array(values * (1 << repeat), np.uint64)
    words, offsets, high = simple8b.encode(a)
    assert (simple8b.decode(words, high) == a).all()
    assert len(offsets) - 1 == -(-len(a) // simple8b.BLOCK)
    for k in range(len(offsets) - 1):
        part = words[offsets[k] : offsets[k + 1]]
        e = np.count_nonzero(words[: offsets[k]] >> np.uint64(60) == 0)
        n = np.count_nonzero(part >> np.uint64(60) == 0)
        assert (simple8b.decode(part, high[e : e + n]) == a[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(1024, np.uint64))[0]) <= 15
    assert len(simple8b.encode(np.full(1020, 2**15 - 1, np.uint64))[0]) == 255


@pytest.mark.parametrize("memory", [200, 1 << 28])
@pytest.mark.parametrize("small", [2, 512])
def test_suffixes(memory, small, monkeypatch):
    monkeypatch.setattr(induced, "SMALL", small)
    rng = random.Random(6)
    for _ in range(60):
        part = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        t = np.array(part * rng.choice([1, 3]) + [0], np.uint16)
        order, lcp = induced.suffixes(t, 6, 100, memory)
        got = [(i, v) for i, v in zip(order.tolist(), lcp.tolist(), strict=True) if i < len(t) - 1]
        text = t.tolist()
        want = sorted(range(len(t) - 1), key=lambda i: text[i:])
        assert [i for i, _ in got] == want
        for (_, v), a, b in zip(got[1:], want, want[1:], strict=False):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert v == min(100, k)


def package(build, **options) -> ZipRanges:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, **options) as z:
        build(z)
    data = f.getvalue()
    return ZipRanges(lambda n, at: data[at : at + n], len(data))


def test_zip_ranges():
    def build(z):
        z.comment = b"PK\x05\x06 a comment that looks like an end"
        z.writestr("a/é.txt", b"0123456789")
        z.writestr("b", b"x" * 100)

    z = package(build)
    assert list(z.members) == ["a/é.txt", "b"]
    assert z.read("a/é.txt", 4, 3) == b"3456"
    with pytest.raises(BadPackage):
        z.read("b", 5, 98)
    with pytest.raises(BadPackage):
        ZipRanges(lambda n, at: b"junk"[at : at + n], 4)
    with pytest.raises(BadPackage, match="compressed"):
        package(lambda z: z.writestr("c", b"y" * 99, zipfile.ZIP_DEFLATED)).read("c", 1)


def test_zip64(monkeypatch):
    """Directory and members past the limits, which are lowered for the test."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)

    def build(z):
        for k in range(5):
            with z.open(f"m{k}", "w", force_zip64=True) as f:
                f.write(bytes([k]) * 200)

    z = package(build, allowZip64=True)
    assert [z.members[f"m{k}"].size for k in range(5)] == [200] * 5
    assert z.read("m4", 3, 197) == b"\4\4\4"


@pytest.mark.parametrize("revisit", [False, True])
def test_warc_record(revisit):
    payload = "<p>é</p>\r\n\r\nWARC/1.1".encode()
    r = warc.parse(warc.record(7, "http://a b/\n", payload, "00" * 20, 9 if revisit else None, revisit))
    assert r["fields"]["warc-type"] == ("revisit" if revisit else "response")
    assert r["fields"]["warc-target-uri"] == "http://a%20b/%0A"
    assert r["payload"] == (b"" if revisit else payload)
    assert int(r["http"]["content-length"]) == len(payload)
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse(zlib.compress(b"nothing\r\n\r\n", wbits=31))


def test_html_article():
    page = """<html><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies all over.</div>
    <div id=main><article class="post"><header><h2>A &amp; title</h2></header><p>First  <b>bold<br>part</b> of it.<p>Second one, <a href=q>linked</a>.<ul><li>one<li>two</ul></article>
    <aside>Other things to read</aside></div><div class="comments"><p>A reader says that this is a rather long comment, really.</p></div>
    <form><p>Your address</p></form><script>var x = "<p>no</p>";</script><style>p{}</style><footer>&copy; us</footer></body></html>"""
    assert htmltext.main_text(page) == "A & title\n\nFirst bold part of it.\n\nSecond one, linked.\n\none\n\ntwo"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p>only", "only"), ("bare &lt;3 text", "bare <3 text"),
    ("<div>" * 3000 + "deep", "deep"), ("<nav><a href=1>menu</a></nav>", ""), ("<!-- c --><p>a<!-- <p>b</p> -->c</p></div></p>", "ac"),
    ("<div class='with-sidebar'><article><p>Inside.</p></article></div>", "Inside."), ("<p>a &#8212; b&nbsp;c", "a — b c"),
])
def test_html_cases(page, text):
    assert htmltext.main_text(page) == text
