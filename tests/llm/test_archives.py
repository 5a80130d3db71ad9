"""Legacy archives and main text."""

import gzip

import pytest

from pageloom.llm import maintext, warc
from pageloom.session import scratch_path

ROWS = [
    (1, "http://a.com/x y", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (3, None, None), (4, "", ""),
    (5, "http://c.com/é", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50), (6, "http://d.com/", "x" * 300000), (6, "http://d.com/", "x" * 300000),
    (None, "http://e.com/", "<p>same</p>"), (7, "http://f.com/", "other\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "y") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark, pages):
    path = scratch_path(spark, "test-warc")
    warc.convert(warc.arc_records(warc.arc_archives(pages)), path)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.record_id: r.page_id for r in rows}
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, by_id.get(r.refers_to_id)) for r in rows}
    last = {}
    for p, _, h in ROWS:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    assert got == {
        (p, len((h or "").encode()), warc.digest_of((h or "").encode()), *(("response", None) if p == last[h or ""] else ("revisit", last[h or ""])))
        for p, _, h in ROWS
    }
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == set(last)
    assert {r.uri for r in rows if r.page_id in (1, 3, 4)} == {"http://a.com/x y", "urn:page:3", "urn:page:4"}


def test_empty_table(spark, pages):
    path = scratch_path(spark, "test-warc")
    warc.convert(warc.arc_records(warc.arc_archives(pages.where("false"))), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_versions(version, zipped):
    content = warc.write_arc([(9, "http://a.com/b c", b"body\n\nmore"), (None, "dns:x", b"")], version, "n.arc", "20030405060708")
    content = gzip.compress(content[:100]) + gzip.compress(content[100:]) if zipped else content
    first, second = warc.read_arc(content)
    assert first[1:5] == (9, "response", "http://a.com/b c", "2003-04-05T06:07:08Z")
    assert (first[7], first[8], first[10]) == (b"body\n\nmore", 10, False)
    assert second[1] is None and second[7] == b""


def test_cut_record_and_plain_body():
    head = b"filedesc://x 0.0.0.0 20030405060708 text/plain 14\n1 0 x\nURL IP-a\n"[:64]
    block = b"1 0 someone\n\n"
    archive = b"filedesc://x 0.0.0.0 20030405060708 text/plain %d\n" % len(block) + block + b"\ndns:a 1.1.1.1 20030405 text/dns 3\nabc\nhttp://z 1.1.1.1 20030405060708 text/html 50\nHTTP/1.0 200 OK\r\n\r\nhalf"
    del head
    dns, cut = warc.read_arc(archive)
    assert (dns[2], dns[4], dns[7]) == ("resource", "2003-04-05T00:00:00Z"[:10] + "T00:00:00Z", b"abc")
    assert cut[10] and cut[7] == b"half"


PAGES = {
    "": "",
    "just words": "just words",
    "<title>T</title><header><h1>Site</h1></header><div id=main-menu><a href=x>A</a></div><div class='content'><h2>Tea &amp; more</h2><p>One two\n three.<div class='ad-box'>BUY</div><p>With <b>bo</b>ld words.</div><div class=comments><p>nice post friend</p></div><footer>x</footer>": "Tea & more One two three. With bold words.",
    "<body class=has-sidebar><div class=cookie-notice>We use cookies</div><main><p>Alpha beta.</p><form>Name</form><p>Gamma</p></main><aside>side words</aside>": "Alpha beta. Gamma",
    "<article><p>Body text here</p><script>var a='</p>';</script><style>p{}</style><!-- note --><p>End.</p></article>": "Body text here End.",
}


def test_main_text_of_known_pages(spark):
    for page, text in PAGES.items():
        assert maintext.extract_text(page, {}) == text
    assert maintext.extract_text("<div>" * 30000 + "deep" + "</div>" * 30000, {}) in ("deep", "")


def test_main_text_of_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in maintext.extract(pages, maintext.fit(pages)).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<(/?)(p|h1|br)\b[^>]*>", " ", inner))
        text = " ".join(html.unescape(inner).split())
        assert got[r.page_id] == (text, len(text))


def test_main_text_edges(spark, pages):
    rows = maintext.extract(pages, maintext.fit(pages)).collect()
    assert len(rows) == len(ROWS) and {r.text for r in rows if r.page_id in (3, 4)} == {""}
    assert maintext.extract(pages.where("false"), {}).count() == 0


PROSE = "the quiet river ran past the old mill and on to the sea"
WEIGHTS = {"p": 2.0, "li a": -2.0, "td": 1.0}


@pytest.mark.parametrize(
    "page, text",
    [
        # an unclosed item, cell or paragraph of a region ends with the next one
        (f"<ul><li class=ad>buy now<li>{PROSE}<li>{PROSE}</ul>", f"{PROSE} {PROSE}"),
        (f"<table><tr><td class='sponsor'>buy now<td>{PROSE}<tr><td>{PROSE}</table>", f"{PROSE} {PROSE}"),
        (f"<div><p class=advert>buy now<p>{PROSE}<p>{PROSE}</div>", f"{PROSE} {PROSE}"),
        # and so it does with the end of its parent
        (f"<div><ul><li class=promo>buy now</ul><p>{PROSE}</div><p>{PROSE}", f"{PROSE} {PROSE}"),
        # names that only hold a word of another meaning
        (f"<div id='post-related-work'><p>{PROSE}</div>", PROSE),
        (f"<div class='search social widget'><p hidden>{PROSE}</div>", PROSE),
        # a nested element of the region's name
        (f"<div class=ad><div>buy</div>now</div><p>{PROSE}", PROSE),
        # an article is no part of the region it stands in
        (f"<div class=sidebar><p>short</p><article><p>{PROSE}</article></div>", PROSE),
        # a long region inside an article doesn't part it
        (f"<p>{PROSE}</p><div class=comments>{'first! ' * 3000}</div><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
        # more than 64 open blocks
        ("<div>" * 100 + f"<p>{PROSE}<ul>" + "<li><div>x y" * 90 + "</div></ul>" + "</div>" * 100 + f"<p>{PROSE}", None),
        # an inline element that ends inside a later block
        (f"<p><b>{PROSE}<p>{PROSE}</b> {PROSE}", f"{PROSE} {PROSE} {PROSE}"),
    ],
)
def test_main_text_nesting(page, text):
    got = maintext.extract_text(page, WEIGHTS)
    assert got == text if text is not None else got.startswith(PROSE) and got.endswith(PROSE)


def test_main_text_is_chosen_by_the_scan(spark):
    """Lists of links without any telling name are known by the weights of labelled pages alone."""
    links = "".join(f"<li><a href=/{i}>see page number {i}</a></li>" for i in range(12))
    labelled = [f"<body><nav><ul>{links}</ul></nav><article><h1>On mills</h1><p>{PROSE}</p></article></body>"] * 30
    plain = f"<body><div><ul>{links}</ul></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><ul>{links}</ul></div></body>"
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate([*labelled, plain])], "page_id long, url string, html string")
    weights = maintext.fit(pages)
    assert weights["li a"] < -1 and weights["p"] > 1 and weights["@menu"] < 0
    assert maintext.extract_text(plain, weights) == f"{PROSE} {PROSE}"

    class Equal(dict):
        def get(self, kind, other=None):
            return 1.0

    assert maintext.extract_text(plain, Equal()).startswith("see page number 0")
