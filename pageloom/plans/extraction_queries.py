"""Scans, extraction, warnings, pagination and hooks over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.hooks import Hooks, PostContext, dedupe_by, hook_transform, keep_first, rating_word, sort_by_number
from pageloom.operators import frontier
from pageloom.operators.extract import extract, trees_for, warnings_of
from pageloom.operators.shred import node_table, shred
from pageloom.plans.registry import query
from pageloom.plans.tables import collapsed, decoded, longs, pages, table
from pageloom.session import scratch_path
from pageloom.site import Site, run_meta
from pageloom.sources.pages import read_html_files, spread, write_html_files
from pageloom.sources.sinks import write_result
from pageloom.spec import Resource, parse_spec, spec_from_dict
from pageloom.streaming.jobs import start_extraction, stream_pages


def one_resource(fields: dict, row_selector: str | None = None, **extra) -> Resource:
    shape = {"list": {"selector": row_selector, "fields": fields}} if row_selector else {"item": {"fields": fields}}
    spec = spec_from_dict(
        {
            "name": "sample",
            "baseUrl": "https://example.com",
            "resources": [{"name": "r", "fetch": {"path": "/"}, **shape, **extra}],
        }
    )
    return spec.resources[0]


def extracted(spark, sf_dir, resource: Resource, hooks: Hooks | None = None) -> DataFrame:
    trees = trees_for(pages(spark, sf_dir), [resource], ["page_id", "url", "final_url"])
    return longs(extract(trees, resource, ["page_id"], hooks))


NAV_SQL = """
nav as (
  select page_id, url,
         unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) as href,
         unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) as label,
         unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')))) as row_no
  from pages)
"""
H1_SQL = collapsed(decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))
NAV_LIST = """regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)"""

# ---- scans and trees ----------------------------------------------------------


@query("select page_id, url, url as final_url, length(html) as n_chars from pages")
def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(
        pages(spark, sf_dir).select("page_id", "url", "final_url", F.length("html").alias("n_chars"))
    )


@query(
    """
    with clean as (select page_id, regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g') as h
                   from pages)
    select page_id, tag, count(*) as n from (
      select page_id, unnest(regexp_extract_all(h, '<(html|head|meta|title|style|script|body|nav|ul|li|a|div|article|h1|p|br|footer)[ >]', 1)) as tag
      from clean) group by page_id, tag
    """
)
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = shred(pages(spark, sf_dir), ["page_id"], markup=False, members=["tag"])
    nodes = node_table(trees, ["page_id"], ["tag"]).where(F.col("tag") != "b")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"with {NAV_SQL} select page_id, label, href from nav")
def sql_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page trees in SQL: a view with a row per element."""
    trees = shred(pages(spark, sf_dir), ["page_id"], markup=False, attrs=["href"])
    node_table(trees, ["page_id"], ["tag", "attrs", "text"]).createOrReplaceTempView("page_nodes")
    return spark.sql(
        r"select page_id, trim(regexp_replace(text, '\\s+', ' ')) as label, attrs['href'] as href from page_nodes where tag = 'a'"
    )


TITLE_SQL = collapsed(decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)"))


@query(
    f"""with {NAV_SQL}, heads as (select url, {TITLE_SQL} as title from pages)
    select label, count(*) as n, count(distinct page_id) as n_pages, count(distinct title) as n_titles,
           max(title) as last_title, sum(row_no * length(title))::bigint as weight
    from nav join heads using (url) group by label"""
)
def resource_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two resources of one site as SQL views over one stored parse, joined."""
    spec = parse_spec(
        """
        name: sample
        baseUrl: https://example.com
        resources:
          - name: nav-links
            fetch: {path: /}
            list: {selector: nav li, fields: {label: a}}
          - name: heads
            fetch: {path: /}
            item: {fields: {title: title}}
        """
    )
    site = Site(spec, pages(spark, sf_dir))
    site.store()
    links, heads = site.create_views("sample_", each_page=True)
    return spark.sql(
        f"""select label, count(*) as n, count(distinct url) as n_pages, count(distinct title) as n_titles,
                   max(title) as last_title, sum(links._row_no * length(title)) as weight
            from {links} links join {heads} heads using (url) group by label"""
    )


# ---- rows and fields ------------------------------------------------------------


@query(f"with {NAV_SQL} select page_id, row_no, label, href from nav")
def list_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = one_resource({"label": "a", "href": {"selector": "a", "attr": "href"}}, "nav li")
    rows = extracted(spark, sf_dir, resource)
    return rows.select("page_id", F.col("_row_no").alias("row_no"), "label", "href")


@query(f"select page_id, {H1_SQL} as h1 from pages")
def item_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir, one_resource({"h1": "h1"})).select("page_id", "h1")


@query(f"select page_id, array_to_string({NAV_LIST}, '|') as labels, len({NAV_LIST}) as n from pages")
def many_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(spark, sf_dir, one_resource({"labels": {"selector": "nav a", "many": True}}))
    return longs(rows.select("page_id", F.array_join("labels", "|").alias("labels"), F.size("labels").alias("n")))


@query(
    f"""
    select page_id, {NAV_LIST}[1] as first_label, {NAV_LIST}[-1] as last_label, {NAV_LIST}[2] as second_label,
           len({NAV_LIST}) - 1 as n_adjacent, len({NAV_LIST}) - 1 as n_following,
           (len({NAV_LIST}) - 2) as n_inner, len({NAV_LIST}) as n_nested, len({NAV_LIST}) - 2 as n_mixed, 'utf-8' as charset,
           {collapsed(decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} as head_title,
           {collapsed(decoded("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))} as ad,
           len(list_filter(regexp_extract_all(html, '<li><a href="([^"]*)">', 1),
               lambda h: h like '/%.')) as n_dotted
    from pages
    """
)
def selector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(selector: str) -> dict:
        return {"selector": selector, "many": True}

    resource = one_resource(
        {
            "first_label": "nav > ul > li:first-child a",
            "last_label": "nav li:last-child > a",
            "second_label": "ul li:nth-child(2) a",
            "n_adjacent": count("li + li"),
            "n_following": count("nav li ~ li"),
            "n_inner": count("nav li:not(:first-child):not(:last-child)"),
            "n_nested": count("html body nav li a"),
            "n_mixed": count("h6 ~ p i, body > nav li:first-child + li ~ li > a"),
            "charset": {"selector": "meta[charset]", "attr": "charset"},
            "head_title": "h6, head > title, .none",
            "ad": '[class*="a"]',
            "n_dotted": count('a[href^="/"][href$="."]'),
        }
    )
    rows = extracted(spark, sf_dir, resource)
    sizes = {n: F.size(n).alias(n) for n in rows.columns if n.startswith("n_")}
    return longs(rows.drop("_warnings", "_row_no").select(*[sizes.get(n, F.col(n)) for n in rows.columns if not n.startswith("_")]))


@query(
    """
    select page_id, regexp_extract(html, '<ul>(.*?)</ul>', 1) as menu_html,
           regexp_extract(html, '<script>(.*?)</script>', 1) as script,
           regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, '' as no_attr
    from pages
    """
)
def inner_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = one_resource(
        {
            "menu_html": {"selector": "nav ul", "html": True},
            "script": "script",
            "lang": {"selector": "html", "attr": "lang"},
            "no_attr": {"selector": "nav a", "attr": "title"},
        }
    )
    return extracted(spark, sf_dir, resource).select("page_id", "menu_html", "script", "lang", "no_attr")


MISSING = {
    "with_default": {"selector": ".nope", "default": "none"},
    "null_default": {"selector": ".nope", "default": None, "transform": "int"},
    "is_optional": {"selector": ".nope", "optional": True},
    "required": {"selector": "h1 .nope", "transform": "float"},
    "many": {"selector": ".nope", "many": True, "default": "x"},
    "odd": {"selector": "li a", "many": True, "transform": ["shout", "upper"]},
}


@query(
    """
    select page_id, 'none' as with_default, cast(null as bigint) as null_default,
           cast(null as varchar) as is_optional, cast(null as double) as required, 0::bigint as n_many from pages
    """
)
def missing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(spark, sf_dir, one_resource(MISSING))
    return longs(
        rows.select("page_id", "with_default", "null_default", "is_optional", "required", F.size("many").alias("n_many"))
    )


WARNINGS_SQL = f"""
    select page_id, 'required' as field, 'no match for selector "h1 .nope"' as message from pages
    union all
    select page_id, 'odd', 'unknown transform "shout" (not built-in and not found in hooks)'
    from (select page_id, unnest({NAV_LIST}) as label from pages)
"""


@query(WARNINGS_SQL)
def extraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warnings_of(extracted(spark, sf_dir, one_resource(MISSING)), ["page_id"])


@query(f"select field, message, count(*) as n, count(distinct page_id) as n_pages from ({WARNINGS_SQL}) group by all")
def warnings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warnings_of(extracted(spark, sf_dir, one_resource(MISSING)), ["page_id"])
    return found.groupBy("field", "message").agg(
        F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages")
    )


@query(
    """
    select 'r' as resource, 'u' || user_id as source, count(page_id) as pages,
           coalesce(bool_or(page_id % 3 = 0), false) as from_cache, max(page_id * 1000) as fetched_ms,
           'max_pages' as stop_reason
    from events left join pages on page_id = event_id % (select 2 * count(*) from pages)
    group by user_id
    """
)
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta rows for runs whose visits are taken from the event log."""
    known = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("url"),
        (F.col("page_id") % 3 == 0).alias("from_cache"),
        F.timestamp_millis(F.col("page_id") * 1000).alias("fetched_at"),
    )
    # every page is visited, and as many that are missing
    n_pages = known.count()
    visits = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("_source"),
        (F.col("event_id") % (2 * n_pages)).cast("string").alias("url"),
        F.lit("max_pages").alias("_stop"),
    )
    meta = run_meta("r", visits, known)
    return longs(
        meta.select("resource", "source", "pages", "from_cache", F.unix_millis("fetched_at").alias("fetched_ms"), "stop_reason")
    )


# ---- pagination ------------------------------------------------------------------


@query(
    f"""
    with {NAV_SQL}, last as (select * from nav qualify row_number() over (partition by page_id order by row_no desc) = 1)
    select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') ||
           replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as next_url,
           cast(null as varchar) as stop
    from last
    """
)
def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's next link, taken from its last menu entry."""
    resource = one_resource({"a": "a"}, "nav", fetch={"path": "/", "pagination": {"type": "link", "selector": "nav li:last-child a"}})
    trees = trees_for(pages(spark, sf_dir), [resource], ["page_id", "url", "final_url"])
    step = frontier.next_page(resource.pagination, trees.columns)
    return trees.select("page_id", F.inline(F.array(step))).withColumnRenamed("url", "next_url")


@query(
    """
    with recursive edges as (
      select url, case when page_id % 7 <> 0 then lead(url) over (order by page_id) end as next_url from pages),
    walk as (
      select url as source, 0 as page_no, url from pages
      union all
      select source, page_no + 1, next_url from walk join edges using (url) where next_url is not null and page_no < 4)
    select source, page_no::bigint as page_no, url,
           case when max(page_no) over (partition by source) = 4 then 'max_pages' else 'no_next' end as stop
    from walk
    """
)
def walk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of up to five pages from every page along next links by page number."""
    known = table(spark, sf_dir, "pages").select("page_id", "url")
    following = known.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    edges = known.join(following, "page_id", "left").select(
        "url",
        F.when(F.col("page_id") % 7 != 0, F.col("next_url")).alias("next_url"),
        F.lit(frontier.NO_NEXT).alias("stop"),
    )
    visits = frontier.walk(known.select(F.col("url").alias("_source")), edges, 5)
    return longs(
        visits.select(
            F.col("_source").alias("source"), F.col("_page_no").alias("page_no"), "url", F.col("_stop").alias("stop")
        )
    )


LONG_SQL = """
    with recursive edges as (select page_id, lead(url) over (order by page_id) as next_url, url from pages),
    walk as (
      select url as source, 0 as page_no, url from pages where page_id % 3 = 0
      union all
      select source, page_no + 1, case when page_id % 50 = 49 then back else next_url end
      from walk join (select *, max(case when page_id % 50 = 17 then url end) over (partition by page_id // 50) as back from edges) using (url)
      where case when page_id % 50 = 49 then back else next_url end is not null and page_no < 63)
    select source, page_no::bigint as page_no, url,
           case when max(page_no) over (partition by source) = 63 then 'max_pages' else 'no_next' end as stop
    from walk
"""


@query(LONG_SQL)
def walk_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of up to 64 pages that run into cycles: each 50th page leads back by 32."""
    known = table(spark, sf_dir, "pages").select("page_id", "url")
    following = known.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    back = known.where("page_id % 50 = 17").select((F.col("page_id") + 32).alias("page_id"), F.col("url").alias("back"))
    edges = known.join(following, "page_id", "left").join(back, "page_id", "left").select(
        "url",
        F.when(F.col("page_id") % 50 == 49, F.col("back")).otherwise(F.col("next_url")).alias("next_url"),
        F.lit(frontier.NO_NEXT).alias("stop"),
    )
    starts = known.where("page_id % 3 = 0").select(F.col("url").alias("_source"))
    visits = frontier.walk(starts, edges, 64)
    return longs(
        visits.select(
            F.col("_source").alias("source"), F.col("_page_no").alias("page_no"), "url", F.col("_stop").alias("stop")
        )
    )


@query(
    """
    select p_partkey, n as page_no, case when n = 0 then u else regexp_replace(u, 'page=[0-9]*', 'page=' || (3 + 2 * n)) end as url
    from (select p_partkey, 'https://shop.example.com/list?q=' || replace(p_name, ' ', '+') || '&page=3&x=1' as u from part)
    cross join range(4) t(n)
    """
)
def query_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(
        F.lit("https://shop.example.com/list?q="), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("&page=3&x=1")
    )
    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    starts = parts.select("p_partkey", source.alias("_source"))
    numbered = frontier.query_pages(starts, "page", start=1, step=2, max_pages=4)
    return longs(numbered.select("p_partkey", F.col("_page_no").alias("page_no"), "url"))


@query(
    """
    select p_partkey, 'https://shop.example.com/b/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') as start_url
    from part
    """
)
def start_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    starts = frontier.start_urls(params, "/b/{brand}/{name}", "https://shop.example.com/x")
    return starts.select("p_partkey", F.col("_source").alias("start_url"))


# ---- hooks ---------------------------------------------------------------------------


@query(f"with {NAV_SQL} select page_id, row_no, upper(replace(label, 'ß', 'SS')) || '!' as label, 1::bigint as n from nav")
def hook_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom value transforms: one as a column, one over pandas batches."""
    hooks = Hooks(
        {
            "shout": hook_transform()(lambda v, base: F.concat(F.upper(v), F.lit("!"))),
            "one": hook_transform(returns="bigint", kind="series")(lambda v, base: v.notna().astype("int64")),
        }
    )
    resource = one_resource(
        {"label": {"selector": "a", "transform": "shout"}, "n": {"selector": "a", "transform": "one"}}, "nav li"
    )
    rows = extracted(spark, sf_dir, resource, hooks)
    return rows.select("page_id", F.col("_row_no").alias("row_no"), "label", "n")


@query(
    """
    select p_partkey, case p_size % 7 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 5 end::bigint as rating
    from part
    """
)
def hook_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("Zero", "One", "TWO", "three", "Four", "Five ", "Six")])
    css = F.concat(F.lit(" Star-Rating "), F.get(words, F.col("p_size") % 7))
    rated = table(spark, sf_dir, "part").select("p_partkey", rating_word.apply(css, F.lit("")).alias("rating"))
    return longs(rated)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("s").alias("_source"),
        (F.col("p_partkey") / 100).cast("int").alias("_page_no"),
        (F.col("p_partkey") % 100).cast("int").alias("_row_no"),
        "p_name",
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"),
    )


CONTEXT = PostContext("https://example.com", None, None)
CATALOGUE_SQL = """
    (select p_partkey, (p_partkey // 100)::bigint as page_no, (p_partkey % 100)::bigint as row_no, p_name,
            case when p_size > 5 then p_retailprice end as price from part)
"""


def _numbered(df: DataFrame) -> DataFrame:
    return longs(
        df.select(F.col("_page_no").alias("page_no"), F.col("_row_no").alias("row_no"), "p_name", "price")
    )


@query(
    f"""select page_no, row_no, p_name, price, row_number() over (order by coalesce(price, 0), page_no, row_no) - 1 as place
    from {CATALOGUE_SQL}"""
)
def hook_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the hook's order, with their place in it as written: file by file, row by row."""
    path = scratch_path(spark, "sorted")
    _numbered(sort_by_number("price")(_catalogue(spark, sf_dir), CONTEXT)).write.parquet(path)
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    placed = spark.read.parquet(path).select("*", file.alias("_file"), row.alias("_row"))
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return placed.join(starts, "_file").select(
        "page_no", "row_no", "p_name", "price", (F.col("_from") + F.col("_row")).alias("place")
    )


@query(f"select page_no, row_no, p_name, price from {CATALOGUE_SQL} order by page_no, row_no limit 25")
def hook_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(keep_first(25)(_catalogue(spark, sf_dir), CONTEXT))


@query(
    f"""
    select f.page_no, f.row_no, p_name, l.price from
      (select p_name, arg_min(page_no, p_partkey) as page_no, arg_min(row_no, p_partkey) as row_no
       from {CATALOGUE_SQL} group by p_name) f
      join (select p_name, price from {CATALOGUE_SQL}
            qualify row_number() over (partition by p_name order by p_partkey desc) = 1) l using (p_name)
    """
)
def hook_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(dedupe_by("p_name")(_catalogue(spark, sf_dir), CONTEXT))


# ---- whole runs ------------------------------------------------------------------------


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as numbered leaves of one list; every fifth is missing."""
    numbered = pages(spark, sf_dir).where("page_id % 5 <> 0")
    return numbered.select(F.concat(F.lit("https://example.com/list?n="), F.col("page_id")).alias("url"), "html")


def _leaf_site(spark: SparkSession, sf_dir: str, hooks: Hooks | None = None, leaves: DataFrame | None = None, **extra) -> Site:
    resource = {
        "name": "nav",
        "fetch": {"path": "/list?n={n}", "pagination": {"type": "query", "param": "n", "maxPages": 3}},
        "list": {"selector": "nav li", "fields": {"label": "a", "href": {"selector": "a", "attr": "href"}, "gone": ".not-there"}},
        **extra,
    }
    spec = spec_from_dict({"name": "sample", "baseUrl": "https://example.com", "resources": [resource]})
    return Site(spec, _leaves(spark, sf_dir) if leaves is None else leaves, hooks)


def _leaf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("n"))


# per start: how many of the next three leaves are there in a row
LEAVES_SQL = f"""
{NAV_SQL},
leaf as (select page_id from pages where page_id % 5 <> 0),
runs as (select page_id as n, 'https://example.com/list?n=' || page_id as source,
    page_id in (select page_id from leaf) as e0, page_id + 1 in (select page_id from leaf) as e1, page_id + 2 in (select page_id from leaf) as e2 from pages),
walked as (select n, source, (case when not e0 then 0 when not e1 then 1 when not e2 then 2 else 3 end)::bigint as pages from runs),
visited as (select source, n + k as page_id, k as page_no from walked join (values (0), (1), (2)) as v(k) on k < pages)
"""


@query(f"with {LEAVES_SQL} select source, pages, case when pages < 3 then 'missing_page' else 'max_pages' end as stop_reason from walked")
def walk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from every page over up to three leaves, and why it ended."""
    result = _leaf_site(spark, sf_dir).resource("nav", _leaf_runs(spark, sf_dir))
    return longs(result.meta.select("source", "pages", "stop_reason"))


@query(
    f"""with {LEAVES_SQL}, rows as (select source, count(*) as k from visited join nav using (page_id) group by source)
    select source, pages, coalesce(k, 0)::bigint as n_rows, coalesce(k, 0)::bigint as n_warnings from walked left join rows using (source)"""
)
def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data, warnings and meta of those runs, written and read back."""
    path = scratch_path(spark, "result")
    write_result(_leaf_site(spark, sf_dir).resource("nav", _leaf_runs(spark, sf_dir)), path)
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    counted = lambda name, n: part(name).groupBy(F.col("_source").alias("source")).agg(F.count("*").alias(n))
    joined = part("meta").select("source", "pages").join(counted("data", "n_rows"), "source", "left")
    return longs(joined.join(counted("warnings", "n_warnings"), "source", "left").fillna(0, ["n_rows", "n_warnings"]))


CAPTURES_SQL = f"""with {LEAVES_SQL}, rows as (
      select source, count(*) as k, count(distinct label) as n_labels, max(page_no * 100 + row_no)::bigint as last
      from visited join nav using (page_id) group by source)
    select source, pages, case when pages < 3 then 'missing_page' else 'max_pages' end as stop_reason,
           {{at}} as fetched_ms, coalesce(k, 0)::bigint as n_rows, coalesce(n_labels, 0)::bigint as n_labels, last
    from walked left join rows using (source)"""


def _run_figures(site: Site, runs: DataFrame) -> DataFrame:
    result = site.resource("nav", runs)
    counted = result.data.groupBy(F.col("_source").alias("source")).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("label").alias("n_labels"),
        F.max(F.col("_page_no") * 100 + F.col("_row_no")).alias("last"),
    )
    meta = result.meta.select("source", "pages", "stop_reason", F.unix_millis("fetched_at").alias("fetched_ms"))
    return longs(meta.join(counted, "source", "left").fillna(0, ["n_rows", "n_labels"]))


@query(CAPTURES_SQL.format(at="cast(null as bigint)"))
def captures_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over pages that are all there three times, without times."""
    leaves = _leaves(spark, sf_dir)
    site = _leaf_site(spark, sf_dir, leaves=leaves.unionByName(leaves).unionByName(leaves))
    return _run_figures(site, _leaf_runs(spark, sf_dir))


@query(CAPTURES_SQL.format(at="case when pages > 0 then (n + pages - 1) * 1000 end"))
def captures_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over pages with equal captures of the newest time, older ones, and ones without a time."""
    leaves = _leaves(spark, sf_dir)
    number = F.substring_index("url", "=", -1).cast("bigint")
    at = lambda ms: F.timestamp_millis(ms)
    now = leaves.withColumn("fetched_at", at(number * 1000))
    blank = leaves.withColumn("html", F.lit("<nav><li><a href='/old'>old</a></li></nav>"))
    old = blank.withColumn("fetched_at", at(number * 1000 - 1))
    unknown = blank.withColumn("fetched_at", F.lit(None).cast("timestamp"))
    site = _leaf_site(spark, sf_dir, leaves=now.unionByName(old).unionByName(now).unionByName(unknown))
    return _run_figures(site, _leaf_runs(spark, sf_dir))


@query(
    f"""with {LEAVES_SQL}, rows as (select source, page_no, row_no, label, href from visited join nav using (page_id)),
    firsts as (select label, source, page_no, row_no from rows qualify row_number() over (partition by label order by source, page_no, row_no) = 1),
    lasts as (select label, href from rows qualify row_number() over (partition by label order by source desc, page_no desc, row_no desc) = 1)
    select label, href, source, page_no::bigint as page_no, row_no from firsts join lasts using (label)"""
)
def run_post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those runs with a post-processing hook: one row per label."""
    site = _leaf_site(spark, sf_dir, Hooks({}, {"single": dedupe_by("label")}), postProcess="single")
    data = site.resource("nav", _leaf_runs(spark, sf_dir)).data
    return longs(data.select("label", "href", F.col("_source").alias("source"), F.col("_page_no").alias("page_no"), F.col("_row_no").alias("row_no")))


@query(f"with {NAV_SQL} select label, href, count(*) as n from nav group by label, href")
def saved_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages saved as one file each, read and extracted."""
    folders = write_html_files(pages(spark, sf_dir), scratch_path(spark, "html"))
    resource = one_resource({"label": "a", "href": {"selector": "a", "attr": "href"}}, "nav li")
    rows = extract(trees_for(read_html_files(spark, folders), [resource], ["url", "final_url"]), resource, ["url"])
    return rows.groupBy("label", "href").agg(F.count("*").alias("n"))


# ---- streams ---------------------------------------------------------------------------


@query(f"with {NAV_SQL} select page_id, row_no, label from nav")
def stream_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list extraction as a stream over the same files."""
    spec = spec_from_dict(
        {
            "name": "sample",
            "baseUrl": "https://example.com",
            "resources": [
                {"name": "nav", "fetch": {"path": "/"}, "list": {"selector": "nav li", "fields": {"label": "a"}}}
            ],
        }
    )
    arriving = stream_pages(spark, f"{sf_dir}/pages*.parquet", "page_id bigint, url string, html string")
    out = scratch_path(spark, "nav")
    site = Site(spec, arriving)
    start_extraction(site, "nav", out, out + "-log", keep=("page_id",), availableNow=True).awaitTermination()
    return longs(spark.read.parquet(out).select("page_id", F.col("_row_no").alias("row_no"), "label"))
