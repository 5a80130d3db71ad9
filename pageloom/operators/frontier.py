"""Which pages a resource reads: start URLs, next links, walks and numbered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.cols import fields, let
from pageloom.functions.text import number_text
from pageloom.operators.extract import base_url
from pageloom.operators.selectors import page_predicate, select_ids
from pageloom.session import checkpoint
from pageloom.spec import Pagination

# Reasons a walk ends.
NO_NEXT, BAD_URL, MISSING_PAGE, MAX_PAGES = "no_next", "bad_url", "missing_page", "max_pages"


def start_urls(params: DataFrame, template: str, site_url: str) -> DataFrame:
    """``params`` plus ``_source``: the filled template resolved against the site."""
    columns = {name: F.col(name) for name in params.columns}
    filled = urls.fill_template(template, columns)
    return params.select("*", urls.resolve(filled, F.lit(site_url)).alias("_source"))


def _query_step(url: Column, paging: Pagination) -> Column:
    found = urls.query_param(url, paging.param)
    current = (
        F.when(found.isNull(), F.lit(float(paging.start)))
        .when(F.trim(found) == "", F.lit(0.0))
        .otherwise(F.trim(found).try_cast("double"))
    )
    number = F.coalesce(number_text(current + paging.step), F.lit("NaN"))
    return urls.with_query_param(url, paging.param, number)


def next_page(pagination: Pagination | None, columns: list[str]) -> Column:
    """``struct<url, stop>`` per page: the next URL, or why there is none."""
    nowhere = fields(url=F.lit(None).cast("string"), stop=F.lit(NO_NEXT))
    here = base_url(columns)
    if pagination is None:
        return nowhere
    if pagination.type == "query" and pagination.param:
        return fields(url=_query_step(here, pagination), stop=F.lit(None).cast("string"))
    if pagination.type == "link" and pagination.selector:
        nodes = F.col("nodes")
        first = F.get(select_ids(page_predicate(pagination.selector)), F.lit(0))
        href = let(
            first,
            lambda i: F.coalesce(
                F.when(i.isNotNull(), F.try_element_at(F.get(nodes, i).attrs, F.lit("href"))), F.lit("")
            ),
        )

        def follow(link: Column) -> Column:
            resolved = let(
                urls.resolve(link, here),
                lambda url: fields(url=url, stop=F.when(url.isNull(), F.lit(BAD_URL))),
            )
            return F.when(link == "", nowhere).otherwise(resolved)

        return let(href, follow)
    return nowhere


def walk(starts: DataFrame, edges: DataFrame, max_pages: int, rounds_in_plan: int = 3) -> DataFrame:
    """Follow next links from every ``_source`` for at most ``max_pages`` pages.

    ``edges`` has the known pages: ``url``, ``next_url``, ``stop``; of several rows of one
    URL that with the greatest next URL counts.  Result:
    ``_source, _page_no, url, _stop``, one row per page visited; a page that is not
    in ``edges`` is listed with the reason on it.  Revisits count again, as the cap
    alone bounds a cycle.

    Pointers double: after round k every URL knows the page 2**k links on, and every
    walk its first 2**k pages, so a walk takes log2(max_pages) equi-joins of URLs.
    Positions that lie beyond a walk's end, or the cap, are never made.  Up to
    ``rounds_in_plan`` rounds stay in one plan; longer walks are written between rounds.
    """
    single = edges.groupBy("url").agg(F.max(F.struct("next_url", "stop")).alias("_edge"))
    links = single.select(
        F.col("url").alias("_url"), F.col("_edge.next_url").alias("_next"), F.col("_edge.stop").alias("_why")
    )
    rounds = max(max_pages - 1, 0).bit_length()
    jump = links.where(F.col("_next").isNotNull()).select("_url", "_next")
    seen = starts.select("_source").distinct().select(
        "_source", F.lit(0).alias("_page_no"), F.col("_source").alias("url")
    )
    for k in range(rounds):
        step = 1 << k
        if k and rounds > rounds_in_plan:
            seen, jump = checkpoint(seen), checkpoint(jump)
        from_here = seen.where(F.col("_page_no") + step < max_pages)
        ahead = from_here.join(jump, F.col("url") == F.col("_url")).select(
            "_source", (F.col("_page_no") + step).alias("_page_no"), F.col("_next").alias("url")
        )
        seen = seen.unionByName(ahead)
        if k + 1 < rounds:
            onward = jump.select(F.col("_url").alias("_next"), F.col("_next").alias("_far"))
            jump = jump.join(onward, "_next").select("_url", F.col("_far").alias("_next"))
    paths = seen.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_page_no", "url"))).alias("_path"))
    ends = paths.withColumn("_end", F.element_at("_path", -1)["url"])
    reason = (
        F.when(F.col("_source").isNull(), F.lit(BAD_URL))
        .when(F.col("_url").isNull(), F.lit(MISSING_PAGE))
        .when(F.size("_path") == max_pages, F.lit(MAX_PAGES))
        .otherwise(F.col("_why"))
    )
    ended = ends.join(links, F.col("_end") == F.col("_url"), "left").select("_source", "_path", reason.alias("_stop"))
    return ended.select("_source", "_stop", F.inline("_path")).select("_source", "_page_no", "url", "_stop")


def query_pages(
    starts: DataFrame, param: str, start: int = 1, step: int = 1, max_pages: int = 1
) -> DataFrame:
    """Numbered pages of every ``_source`` without reading any page.

    The first page is the start URL as written; later ones set ``param``.
    """
    paging = Pagination("query", param=param, start=start, step=step)
    first = urls.query_param(F.col("_source"), param)
    from_url = F.when(F.trim(first) == "", F.lit(0.0)).otherwise(F.trim(first).try_cast("double"))
    base = F.when(first.isNull(), F.lit(float(paging.start))).otherwise(from_url)
    number = F.coalesce(number_text(base + F.col("_page_no") * step), F.lit("NaN"))
    numbered = starts.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("_page_no"))
    url = F.when(F.col("_page_no") == 0, F.col("_source")).otherwise(
        urls.with_query_param(F.col("_source"), param, number)
    )
    return numbered.select("*", url.alias("url"))
