import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference
from fixtures import GUIDE, GUIDE_1, GUIDE_MENU
from pageloom import Site, parse_spec
from pageloom.operators import infer


def drafts(spark, *pages):
    df = spark.createDataFrame(list(pages), "url string, html string")
    return {r.url: json.loads(r.draft) for r in infer.infer_drafts(df).collect()}


def test_draft_of_a_grid(spark):
    url = "https://www.paths.example.org/north/all.html?sort=toll#top"
    draft = drafts(spark, (url, GUIDE_1))[url]
    assert (draft["name"], draft["baseUrl"]) == ("paths", "https://www.paths.example.org")
    (resource,) = draft["resources"]
    assert resource["name"] == "items" and resource["list"]["selector"] == "section.card.walk"
    fields = resource["list"]["fields"]
    assert set(fields) == {"title", "url", "price", "image"}
    assert [fields[n]["transform"] for n in ("url", "price", "image")] == [["url"], ["float"], ["url"]]
    assert resource["fetch"]["path"] == "/north/all.html?sort=toll"
    assert resource["fetch"]["pagination"]["selector"] == 'a[rel="next"]'


def test_cards_beat_a_longer_menu_and_the_draft_runs(spark):
    url = f"{GUIDE}/"
    draft = drafts(spark, (url, GUIDE_MENU))[url]
    pages = spark.createDataFrame([(url, GUIDE_MENU)], "url string, html string")
    rows = Site(parse_spec(json.dumps(draft)), pages).resource("items").data.orderBy("price").collect()
    assert [(r.title, r.price) for r in rows] == [("Mill Loop", 3.25), ("Salt Marsh", 7.0), ("Heron Ridge", 12.5), ("Quarry", 1040.5)]
    assert rows[0].image == f"{GUIDE}/pics/w2.webp" and rows[0].url == f"{GUIDE}/walk/2"


def test_a_page_without_rows(spark):
    bare = "<title>Closed</title><h1>Back in May</h1><p>The path is under water."
    told = '<meta name="description" content="Floods">' + bare
    got = drafts(spark, ("https://q.example", bare), ("https://r.example/now", told))
    fields = {url: set(d["resources"][0]["item"]["fields"]) for url, d in got.items()}
    assert fields == {"https://q.example": {"title"}, "https://r.example/now": {"title", "description"}}
    assert got["https://q.example"]["resources"][0]["fetch"]["path"] == "/"
    for draft in got.values():
        parse_spec(json.dumps(draft))


def groups(spark, html):
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    return infer.sibling_groups(infer.infer_trees(pages), ["url"]).collect()


def test_scores(spark):
    rows = "".join(f"<dd class='leg x2 z'><a href=#>stage {i}</a><h5>K</h5></dd>" for i in range(5))
    (g,) = groups(spark, f"<body><dl>{rows}</dl><p>a<p>b<p>c")
    assert (g.signature, g.n) == ("dd.leg.x2", 5)
    # 'stage 0K' is 8 characters, 2 elements, a heading and a link
    assert math.isclose(g.score, (8 + 50 + 6 + 10) * (1 + math.log2(5)))


def test_group_rules(spark):
    assert groups(spark, "<body><h6>a</h6><h6>b</h6><h6>c</h6>") == []
    assert groups(spark, "<body><div>" + "<q>x</q>" * 601 + "</div>") == []
    mixed = "<body><div><q>k</q><script>7</script><script>8</script><script>9</script><q>l</q><q>m</q></div>"
    assert [(g.signature, g.n) for g in groups(spark, mixed)] == [("q", 3)]
    odd = "<body><div><q class='3d fine'>k</q><q class='fine'>l</q><q class='fine'>m</q></div>"
    assert [(g.signature, g.n) for g in groups(spark, odd)] == [("q.fine", 3)]


@pytest.mark.parametrize("name", ["best_group", "sibling_groups"])
def test_queries_take_parents_of_any_size(spark, tmp_path, name):
    """601 paragraphs or 2,000 menu entries are groups like any other, as in the queries' SQL."""
    page = lambda entries, parts: (
        "<body><nav><ul>" + "".join(f"<li><a href=/{i}>to {i}</a></li>" for i in range(entries)) + "</ul></nav>"
        "<article><h1>t</h1>" + "".join(f"<p>part {i}" for i in range(parts)) + "</article></body>"
    )
    sizes = [(4, 601), (2000, 5), (600, 3), (601, 601)]
    rows = [{"page_id": i, "url": f"https://a.example/{i}", "html": page(*n)} for i, n in enumerate(sizes)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "pages.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert {(r.page_id, r.n) for r in found.collect()} >= {(0, 601), (1, 2000), (3, 601)}
    assert difference(found, entry.oracle_sql()[name], str(tmp_path)) is None


def paging(spark, html):
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    return infer.inferred_pagination(infer.infer_trees(pages), ["url"]).first().selector


def test_pagination_link(spark):
    assert paging(spark, "<div class='leaf'><a href=k>Next leaf</a></div>") == ".leaf a"
    assert paging(spark, "<a href=k>Older walks</a><a class='See-More c' href=l>k</a>") == "a.see-more"
    assert paging(spark, "<p class='leaf'><a href=k> next</a><p><a rel=next href=l>z</a>") == 'a[rel="next"]'
    assert paging(spark, "<p class='7'><a href=k>more</a></p><div class='foot'><a>→</a></div>") == ".foot a"
    assert paging(spark, "<a href=k>back</a>") is None


def test_inference_has_no_shuffle(spark):
    pages = spark.createDataFrame([("u", GUIDE_1)], "url string, html string")
    assert "Exchange" not in infer.infer_drafts(pages)._jdf.queryExecution().executedPlan().toString()
    best = infer.best_groups(infer.infer_trees(pages), ["url"])
    assert best.select(F.col("signature")).first()[0] == "section.card.walk"
    (row,) = infer.inferred_fields(infer.infer_trees(pages), ["url"]).collect()
    assert len(row.fields) == 4
