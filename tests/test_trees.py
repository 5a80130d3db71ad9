import inspect
import random

import pyarrow as pa
import pytest

from pageloom.operators.shred import DEPTH, KIDS, NUMBERS, PageTree, _shredder, node_table, shred


def tree(html):
    return "".join(PageTree(html, True).markup)


def body(html):
    out = tree(html)
    return out[out.index("<body>") + 6 : out.rindex("</body>")]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<p>b<div>c</div>", "<p>a</p><p>b</p><div>c</div>"),
        ("<p><b>x<br><p>y</p><p>z", "<p><b>x<br></b></p><p><b>y</b></p><p><b>z</b></p>"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x"),
        ("<table><caption>c<tr><th>h", "<table><caption>c</caption><tbody><tr><th>h</th></tr></tbody></table>"),
        ("<table><col><tr><td>x", "<table><colgroup><col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<td>x</td>", "x"),
        ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"),
        ("<b><i>x</b>y</i>z", "<b><i>x</i></b><i>y</i>z"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("a</p>b", "a<p></p>b"),
        ("x</br>y", "x<br>y"),
        ("<div></span></div>t", "<div></div>t"),
        ("a &lt; b &amp &copy; &#x41;", "a &lt; b &amp; © A"),
        ('<a href="?a=1&copy=2&amp;c">q</a>', '<a href="?a=1&amp;copy=2&amp;c">q</a>'),
        ("<p title='a>b' id=x data-y = \"z\" id=2 hidden>t", '<p title="a>b" id="x" data-y="z" hidden="">t</p>'),
        ("x<script>if (a<b) '</p>'</script>t", "x<script>if (a<b) '</p>'</script>t"),
        ("<textarea>\n<b>&lt;</textarea>", "<textarea>&lt;b&gt;&lt;</textarea>"),
        ("<svg><path d=1 /><g/></svg>t", '<svg><path d="1"></path><g></g></svg>t'),
        ("a<!-- c --><!x><?y?>b", "a<!-- c --><!--x--><!--?y?-->b"),
        ("1 < 2 <3", "1 &lt; 2 &lt;3"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
    ],
)
def test_body(html, expected):
    assert body("<!doctype html>" + html) == expected


def test_same_formatting_is_kept_three_times():
    out = body("<!doctype html><p><b>1<p><b>2<p><b>3<p><b>4<p>5")
    assert out.endswith("<p><b><b><b>5</b></b></b></p>")


def test_head_and_body_are_implied():
    assert tree("") == "<html><head></head><body></body></html>"
    assert tree("hi") == "<html><head></head><body>hi</body></html>"
    assert tree("<title>a&amp;b</title><p>x") == "<html><head><title>a&amp;b</title></head><body><p>x</p></body></html>"
    out = tree("<!doctype html><html lang=en>\n<head>\n<meta charset=x></head>\n<body class=y>t</body></html>\n")
    assert out == '<html lang="en"><head>\n<meta charset="x"></head>\n<body class="y">t\n</body></html>'
    assert tree("<p>1<table><tr><td>x</table>") .count("<p>1<table>") == 1  # no doctype: quirks
    assert tree("<!doctype html><p>1<table><tr><td>x</table>").count("<p>1</p><table>") == 1


def check_invariants(t: PageTree):
    size = len(t.tag)
    column = {name: [row[i] for row in t.rows] for i, name in enumerate(NUMBERS)}
    parent, last, depth = column["parent"], column["last"], column["depth"]
    for n in range(1, size):
        p = parent[n]
        assert 0 <= p < n <= last[n] <= last[p] < size
        assert depth[n] == depth[p] + 1
        assert column["t0"][p] <= column["t0"][n] <= column["t1"][n] <= column["t1"][p] <= len(t.texts)
        assert column["h0"][p] <= column["h0"][n] <= column["h1"][n] <= column["h1"][p] <= len(t.markup)
        kids = [k for k in range(n + 1, last[n] + 1) if parent[k] == n]
        assert len(kids) == column["kids"][n]
        assert [column["idx"][k] for k in kids] == list(range(len(kids)))
        assert [column["prev"][k] for k in kids] == [-1, *kids][: len(kids)]


def test_random_markup_never_fails():
    rng = random.Random(11)
    tags = "p b i a div ul li table tr td th tbody h1 h2 script style title head body html br select option span svg dl dt dd form button pre".split()
    bits = ["<", ">", "</", "<!--", "-->", "<!", "&amp;", "&", '"', "'", "=", " ", "\n", "text", "é", "/"]
    for _ in range(400):
        html = "".join(
            rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"<{rng.choice(tags)} class='a b' x=1>", rng.choice(bits)))
            for _ in range(rng.randrange(1, 60))
        )
        check_invariants(PageTree(html, True))


def test_reparsing_the_serialised_tree_is_stable():
    rng = random.Random(12)
    tags = "p div ul li h1 span em section".split()
    for _ in range(200):
        html = "<!doctype html>" + "".join(
            rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x ")) for _ in range(rng.randrange(1, 40))
        )
        once = tree(html)
        assert tree("<!doctype html>" + once) == once


def test_deep_and_long_pages():
    deep = PageTree("<div>" * 20_000 + "x", True)
    assert max(row[DEPTH] for row in deep.rows) > 500 and deep.texts == ["x"]
    wide = PageTree("<ul>" + "<li>a" * 50_000, False)
    assert wide.rows[4][KIDS] == 50_000
    PageTree("<" * 100_000, True)
    PageTree("<a " + "x" * 200_000, True)
    PageTree("<p a='" * 20_000, True)


def test_frame_shape(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<b>c</b></p>"), (2, "v", None)], "k int, url string, html string")
    frame = shred(pages, ["k"], markup=False, attrs=["href"], chunk_chars=1)
    rows = {r.k: r for r in frame.collect()}
    assert [n.tag for n in rows[1].nodes] == ["", "html", "head", "body", "p", "b"]
    assert rows[1].texts == ["a", "c"] and rows[1].markup == [] and len(rows[2].nodes) == 4
    nodes = node_table(frame, ["k"]).where("k = 1 and tag in ('p', 'b')").collect()
    assert [(n.id, n.parent, n.tag, n.text) for n in nodes] == [(4, 3, "p", "ac"), (5, 4, "b", "c")]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_trees_are_handed_over_in_small_parts():
    page = "<ul>" + "<li><a href='/x'>label</a></li>" * 1000 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"k": list(range(200)), "html": [page] * 200})
    default = inspect.signature(shred).parameters["chunk_chars"].default
    parts = [b.num_rows for b in _shredder(["k"], False, None, ["id", "tag"], default)(iter([batch]))]
    assert sum(parts) == 200 and max(parts) * len(page) <= 1_000_000
