"""Plans are the ones a large cluster needs."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fixtures import SHED_SPEC
from pageloom import Site, parse_spec
from pageloom.operators import frontier
from pageloom.session import checkpoint, scratch_path

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_url_work_does_not_read_html(spark):
    for name in ("url_parts", "robots_admit", "walk_links", "query_param"):
        plan = executed(QUERIES[name](spark, SF))
        assert "html:string" not in plan, name


def test_filters_and_columns_reach_the_scan(pages):
    site = Site(parse_spec(SHED_SPEC), pages.where(F.col("url").startswith("https://m.")))
    plan = executed(site.over_pages("tools"))
    assert "StringStartsWith(url,https://m.)" in plan
    assert "ReadSchema: struct<url:string,html:string>" in plan
    assert "Exchange" not in plan


def test_resources_share_one_parse(pages):
    assert executed(Site(parse_spec(SHED_SPEC), pages).page_rows()).count("MapInArrow") == 1


def test_start_pages_are_picked_before_the_parse(pages):
    plan = executed(Site(parse_spec(SHED_SPEC), pages).resource("sheet").data)
    parse, semi = plan.index("MapInArrow"), plan.index("LeftSemi")
    assert parse < semi  # the semi join is below the parse


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins(spark, name):
    if name.startswith(("stream", "op", "pipeline")):
        pytest.skip("runs to completion when built")
    plan = executed(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # hook_sort numbers the files it wrote, one row each
    assert "SinglePartition" not in plan or name in ("hook_first", "hook_sort")


def test_views_and_sinks_parse_once(spark, pages, tmp_path):
    site = Site(parse_spec(SHED_SPEC), pages)
    parses = []
    result = site.resource("sheet")
    assert executed(result.visited).count("MapInArrow") == 1
    staged = result.staged(str(tmp_path / "visited"))
    for name in ("data", "warnings", "meta"):
        parses.append(executed(getattr(staged, name)).count("MapInArrow"))
    for view in site.create_views("shed_"):
        parses.append(executed(spark.table(view)).count("MapInArrow"))
    assert parses == [0] * len(parses) and len(parses) > 4


def test_checkpoints_go_to_the_named_folder(spark, tmp_path):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        assert checkpoint(spark.range(3)).count() == 3
        assert any(tmp_path.rglob("rdd-*"))
        assert str(tmp_path) in scratch_path(spark, "x")
    finally:
        if before:
            context.setCheckpointDir(before)


def test_long_walks(spark):
    edges = spark.range(200).select(
        F.concat(F.lit("p"), F.col("id")).alias("url"),
        F.when(F.col("id") < 33, F.concat(F.lit("p"), F.col("id") + 1)).alias("next_url"),
        F.lit("no_next").alias("stop"),
    )
    starts = spark.createDataFrame([("p0",), ("p20",), ("p199",), ("none",)], "_source string")
    visits = frontier.walk(starts, edges, 60)
    got = {r._source: (r.n, r.s) for r in visits.groupBy("_source").agg(F.count("*").alias("n"), F.max("_stop").alias("s")).collect()}
    assert got == {"p0": (34, "no_next"), "p20": (14, "no_next"), "p199": (1, "no_next"), "none": (1, "missing_page")}
    cycle = spark.createDataFrame([("a", "b", None), ("b", "a", None)], "url string, next_url string, stop string")
    rows = frontier.walk(cycle.select(F.lit("a").alias("_source")), cycle, 5).orderBy("_page_no").collect()
    assert [r.url for r in rows] == ["a", "b", "a", "b", "a"] and rows[0]._stop == "max_pages"


def test_walks_double_their_pointers(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}", None) for i in range(200)], "url string, next_url string, stop string")
    starts = spark.createDataFrame([("p0",), ("p190",), (None,)], "_source string")
    # seven rounds for 64 pages or more, one plan: a join each for paths and pointers
    plan = frontier.walk(starts, edges, 64, rounds_in_plan=99)._jdf.queryExecution().analyzed().toString()
    assert max(map(int, re.findall(r"_page_no#\d+ \+ (\d+)\) AS", plan))) == 32
    for cap in (1, 2, 3, 63, 64, 65):
        got = {}
        for r in frontier.walk(starts, edges, cap).collect():
            got.setdefault(r._source, []).append((r._page_no, r.url, r._stop))
        assert sorted(got["p0"]) == [(i, f"p{i}", "max_pages") for i in range(cap)]
        end = min(cap, 11)
        stop = "max_pages" if cap <= 10 else "missing_page"
        assert sorted(got["p190"]) == [(i, f"p{190 + i}", stop) for i in range(end)]
        assert got[None] == [(0, None, "bad_url")]
