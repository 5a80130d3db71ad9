import pytest
from pyspark.sql import functions as F

from pageloom import SpecError, parse_spec
from pageloom.functions import text, urls
from pageloom.operators.extract import column_type, extract, trees_for, value_type
from pageloom.operators.selectors import SelectorError, attributes_used, parse_selector
from pageloom.hooks import Hooks
from pageloom.spec import Field, parse_duration


def apply(spark, name, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}").coalesce(1)
    out = df.select("i", text.apply_built_in(name, F.col("v"), dtype, F.lit("https://h/a?x#f")).alias("o"))
    return [r.o for r in out.orderBy("i").collect()]


def test_numbers(spark):
    values = ["£1,234.50", "10 20", "1 of 20", "none", "-3.9", "1.234,50", "", None, "5.", "-"]
    assert apply(spark, "float", values) == [1234.5, 1020, 1, None, -3.9, 1.2345, None, None, 5, None]
    assert apply(spark, "int", values) == [1234, 1020, 1, None, -3, 1, None, None, 5, None]
    assert apply(spark, "number", ["1 000"]) == [1000]


def test_words(spark):
    assert apply(spark, "boolean", [" Yes ", "0", "", "ON", "true", "1", None, "y"]) == [True, False, False, True, True, True, False, False]
    assert apply(spark, "trim", [" a  b ﻿", None]) == ["a  b", ""]
    assert apply(spark, "upper", ["straße", None]) == ["STRASSE", ""]
    assert apply(spark, "lower", ["ÀB"]) == ["àb"]
    assert apply(spark, "upper", [51.0, 1e21, 0.5, 12345678.25, 1e-7, None], "double") == ["51", "1E+21", "0.5", "12345678.25", "1E-7", ""]
    df = spark.createDataFrame([("  a \t\n b c   d",)], "v string")
    assert df.select(text.collapse(F.col("v"))).first()[0] == "a b c d"


@pytest.mark.parametrize(
    "ref, expected",
    [
        ("", "https://h/a?x"), ("/b", "https://h/b"), ("b", "https://h/b"), ("?q=1", "https://h/a?q=1"), ("#z", "https://h/a?x#z"),
        ("//O.com:443/p", "https://o.com/p"), ("../../b/./c/..", "https://h/b/"), ("http://o.com", "http://o.com/"),
        ("mailto:a@b", "mailto:a@b"), ("é d", "https://h/%C3%A9%20d"), ("http://a b/", "http://a b/"), ("/%2e%2e/x%20", "https://h/x%20"),
        ("http://h:99999/", "http://h:99999/"), ("\\x", "https://h/x"), (" /t\n", "https://h/t"), ("/a'b?c'd", "https://h/a'b?c%27d"),
    ],
)
def test_url(spark, ref, expected):
    assert apply(spark, "url", [ref]) == [expected]


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTPS://U@Ex.com:443?q#f",), ("http://e.com:8080/a/b?c=d#e",)], "u string")
    u = F.col("u")
    rows = df.select(urls.origin(u), urls.host(u), urls.path_query(u)).collect()
    assert [tuple(r) for r in rows] == [("https://ex.com", "ex.com", "/?q"), ("http://e.com:8080", "e.com", "/a/b?c=d")]


def test_query_parameters(spark):
    df = spark.createDataFrame([("http://h/a?x=a%20b&page=1&page=3#f",), ("http://h/a",), ("http://h/?page=",)], "u string")
    u = F.col("u")
    rows = df.select(urls.query_param(u, "page"), urls.with_query_param(u, "page", F.lit("7"))).collect()
    assert [tuple(r) for r in rows] == [
        ("1", "http://h/a?x=a+b&page=7#f"), (None, "http://h/a?page=7"), ("", "http://h/?page=7"),
    ]


def test_template(spark):
    df = spark.createDataFrame([("a b/é",), (None,)], "tag string")
    filled = urls.fill_template("/t/{tag}", {"tag": F.col("tag")})
    assert df.where("tag is not null").select(filled).first()[0] == "/t/a%20b%2F%C3%A9"
    with pytest.raises(Exception, match=r"needs a value for \{tag\}"):
        df.select(filled).collect()
    with pytest.raises(ValueError, match="other"):
        urls.fill_template("/{other}", {"tag": F.col("tag")})


# ---- selectors --------------------------------------------------------------------

PAGE = """<!doctype html><body><div id=top class="a b"><p class=x>1</p><p class="x y" data-k="one two">2</p><span>3</span>
<p>4<em>5</em></p></div><div class=c><p title="pre-mid-end">6</p><ul><li>7<li class=z>8<li>9</ul></div><h1 class="1bad">10</h1>"""


def matches(spark, selector):
    spec = parse_spec(f"name: s\nbaseUrl: https://h\nresources: [{{name: r, fetch: {{path: /}}, item: {{fields: {{f: {{selector: '{selector}', many: true}}}}}}}}]")
    pages = spark.createDataFrame([("https://h/", PAGE)], "url string, html string")
    return extract(trees_for(pages, spec.resources, ["url"]), spec.resources[0], []).first().f


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("p", "1 2 45 6"), (".x", "1 2"), ("p.x.y", "2"), ("#top p", "1 2 45"), ("#top > p.x", "1 2"), ("div em", "5"), ("div > em", ""),
        ("p + p", "2"), ("p ~ p", "2 45"), ("span + p", "45"), ("[data-k]", "2"), ("[data-k~=two]", "2"), ("[data-k=one]", ""),
        ("[title^=pre]", "6"), ("[title$=end]", "6"), ("[title*=mid]", "6"), ('[title="pre-mid-end"]', "6"), ("li:first-child", "7"),
        ("li:last-child", "9"), ("li:nth-child(2)", "8"), ("li:not(.z)", "7 9"), ("h1, em , li.z", "5 8 10"), ("div *", None),
        ("body > div > p:first-child", "1 6"), ("div.c li ~ li", "8 9"), ("DIV P.x", "1 2"), ("p:not(:first-child)", "2 45"), ("div div p", ""),
    ],
)
def test_selectors(spark, selector, expected):
    found = matches(spark, selector)
    if expected is None:
        assert len(found) == 10
    else:
        assert found == expected.split()


@pytest.mark.parametrize("bad", ["", "a,", "p:hover", "> p", "a >", "p::before", "[x", "p:nth-child(2n)"])
def test_unsupported_selectors_fail_early(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_attributes_used():
    assert attributes_used("a[href] > img[SRC$='x'], #id:not([rel=y])") == {"href", "src", "id", "rel"}


# ---- missing values, warnings, types --------------------------------------------------


def rows(spark, html, fields, **kind):
    spec = parse_spec(f"{{name: s, baseUrl: 'https://h', resources: [{{name: r, fetch: {{path: /}}, item: {{fields: {fields}}}}}]}}")
    pages = spark.createDataFrame([("https://h/a?b#c", html)], "url string, html string")
    return extract(trees_for(pages, spec.resources, ["url"]), spec.resources[0], []).first()


def test_missing_policy(spark):
    row = rows(
        spark,
        '<div class="x"></div>',
        "{a: .nope, b: {selector: .nope, default: null}, c: {selector: .nope, optional: true}, d: {selector: .nope, default: 7, transform: int},"
        " e: {selector: .nope, many: true, default: z}, f: {selector: .x, attr: id}, g: {selector: .x, attr: href, transform: url}, h: {selector: .x, transform: int}}",
    )
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == (None, None, None, 7, [], "", "https://h/a?b", None)
    assert [(w.field, w.message) for w in row._warnings] == [("a", 'no match for selector ".nope"')]


def test_reads(spark):
    row = rows(
        spark,
        "<title>T</title><p a=' x  y '> one <b>two</b>\n three&nbsp;</p>",
        "{t: p, h: {selector: p, html: true}, a: {selector: p, attr: a}, ah: {selector: p, attr: a, html: true}, whole: {}, w: {html: true, many: true}}",
    )
    assert row.t == "one two three" and row.h == " one <b>two</b>\n three&nbsp;" and row.a == "x y" and row.ah == " x  y "
    assert row.whole == "T one two three" and row.w[0].startswith("<html><head><title>T")


def test_unknown_transform_warns_per_value(spark):
    row = rows(spark, "<p>1<p>2", "{a: {selector: p, many: true, transform: [zap, int]}, b: {selector: p, transform: zap}}")
    assert row.a == [1, 2] and row.b == "1" and len(row._warnings) == 3


def test_types():
    hooks = Hooks()
    assert value_type(Field("f", transform=("float", "upper")), hooks) == "string"
    assert column_type(Field("f", transform=("int",), many=True), hooks) == "array<bigint>"
    with pytest.raises(SpecError):
        parse_spec("name: a\nbaseUrl: https://h\nresources: []")


def test_bad_default_is_rejected(spark):
    with pytest.raises(SpecError, match="default"):
        rows(spark, "", "{a: {selector: p, transform: int, default: x}}")


# ---- site descriptions --------------------------------------------------------------------

GOOD = "name: a\nbaseUrl: https://h.com\nresources:\n  - {name: r, fetch: {path: /}, list: {selector: li, fields: {on: a}}}\n"


def test_defaults():
    spec = parse_spec(GOOD)
    p = spec.politeness
    assert (p.requests_per_second, p.respect_robots, p.cache_ttl_ms, p.timeout_ms, p.max_retries) == (1, True, 600_000, 15_000, 2)
    assert spec.resource("r").fields[0].name == "on"


@pytest.mark.parametrize(
    "change",
    [
        ("https://h.com", "nope"), ("name: r,", "name: r r,"), ("list: {selector: li, fields: {on: a}}", "description: x"), ("path: /", "path: /, extra: 1"),
        ("fields: {on: a}", "fields: {on: {selectr: a}}"), ("path: /", "path: /, pagination: {type: link, maxPages: 0}"), ("name: a", "name: 5"),
        ("name: a", "name: a\npoliteness: {requestsPerSecond: 0}"), ("path: /", "path: /, pagination: {type: jump}"),
    ],
)
def test_rejected(change):
    with pytest.raises(SpecError):
        parse_spec(GOOD.replace(*change))


def test_durations():
    assert [parse_duration(d) for d in ("10m", "30s", "1h", "500", 250, "1.5s", "2 d")] == [600_000, 30_000, 3_600_000, 500, 250, 1500, 172_800_000]
    with pytest.raises(SpecError):
        parse_duration("soon")
