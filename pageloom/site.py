"""A site description applied to a table of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.hooks import Hooks, PostContext, load_hooks
from pageloom.operators import frontier
from pageloom.operators.extract import base_url, extract, finish_rows, raw_rows, trees_for
from pageloom.session import checkpoint, scratch_path
from pageloom.spec import Resource, SiteSpec, load_spec

PAGE_COLUMNS = ("url", "final_url", "from_cache", "fetched_at")


@dataclass(frozen=True)
class Result:
    """What one resource yields: three tables over the visited pages and their raw rows."""

    data: DataFrame
    warnings: DataFrame
    meta: DataFrame
    visited: DataFrame = field(repr=False)
    build: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]] = field(repr=False)

    def staged(self, path: str | None = None) -> Result:
        """The same tables over a written copy of the visited pages: walked and parsed once."""
        spark = self.visited.sparkSession
        path = path or scratch_path(spark, "visited")
        self.visited.write.mode("overwrite").parquet(path)
        visited = spark.read.schema(self.visited.schema).parquet(path)
        return Result(*self.build(visited), visited, self.build)


class Site:
    """Resources of one site as DataFrames over a shared pages table.

    ``pages`` has ``url``, ``html`` and, when known, ``final_url``, ``from_cache`` and
    ``fetched_at``.  With ``fetched_at`` only the newest capture of a URL counts; without it,
    runs take one of a URL's rows, and ``over_pages`` takes every row.  Filter it to the
    site's own pages first; that filter reaches the scan.
    """

    def __init__(self, spec: SiteSpec, pages: DataFrame, hooks: Hooks | None = None) -> None:
        self.spec = spec
        self.hooks = hooks or Hooks()
        self.pages = newest_captures(pages) if "fetched_at" in pages.columns else pages
        self._stored: DataFrame | None = None

    @classmethod
    def from_file(cls, path: str | Path, pages: DataFrame) -> Site:
        """The site described in a file, with the hooks module it names next to it."""
        spec = load_spec(path)
        hooks = None
        if spec.hooks:
            hooks = load_hooks(Path(path).parent / spec.hooks, pages.sparkSession)
        return cls(spec, pages, hooks)

    # -- one pass over the pages -------------------------------------------------
    def page_rows(self, names: Iterable[str] | None = None) -> DataFrame:
        """Raw rows and next link of the named resources, for every page, in one parse.

        Columns: the page's own, ``_digest`` of its markup, then ``rows_<i>`` and ``next_<i>``
        per resource.
        """
        chosen = set(names) if names is not None else {r.name for r in self.spec.resources}
        wanted = [(i, r) for i, r in enumerate(self.spec.resources) if r.name in chosen]
        keep = [*[c for c in PAGE_COLUMNS if c in self.pages.columns], "_digest"]
        trees = trees_for(self.pages.withColumn("_digest", F.xxhash64("html")), [r for _, r in wanted], keep)
        columns = []
        for i, r in wanted:
            columns.append(raw_rows(r).alias(f"rows_{i}"))
            columns.append(frontier.next_page(r.pagination, trees.columns).alias(f"next_{i}"))
        return trees.select(*keep, *columns)

    def store(self, path: str | None = None) -> Site:
        """Keep the raw rows of all resources, so that the pages are parsed once.

        One capture of each URL is kept.  Written as Parquet to ``path``, else to the
        checkpoint folder.  Reading one resource later touches only its own columns.
        """
        path = path or scratch_path(self.pages.sparkSession, "rows")
        rows = one_capture(self.page_rows())
        rows.write.mode("overwrite").parquet(path)
        self._stored = self.pages.sparkSession.read.schema(rows.schema).parquet(path)
        return self

    def _rows(self, resource: Resource) -> DataFrame:
        rows = self._stored if self._stored is not None else one_capture(self.page_rows([resource.name]))
        i = [r.name for r in self.spec.resources].index(resource.name)
        keep = [c for c in PAGE_COLUMNS if c in rows.columns]
        return rows.select(
            *keep, F.col(f"rows_{i}").alias("_rows"), F.col(f"next_{i}").alias("_next")
        )

    # -- resources -----------------------------------------------------------------
    def over_pages(self, name: str, keep: Iterable[str] = ("url",)) -> DataFrame:
        """Apply a resource to every page of the table, wherever it was found.

        Once rows are stored, they are read instead of the pages, where they have all of ``keep``.
        """
        resource = self.spec.resource(name)
        keep = list(keep)
        if self._stored is not None and set(keep) <= set(self._stored.columns):
            rows = self._rows(resource)
            exploded = rows.select(*keep, base_url(rows.columns).alias("_base"), F.posexplode("_rows").alias("_row_no", "_raw"))
            return finish_rows(exploded, resource, self.hooks, [*keep, "_row_no"])
        carried = list(dict.fromkeys([*keep, *[c for c in ("url", "final_url") if c in self.pages.columns]]))
        return extract(trees_for(self.pages, [resource], carried), resource, keep, self.hooks)

    def resource(
        self,
        name: str,
        params: DataFrame | None = None,
        max_pages: int | None = None,
        strict: bool = False,
    ) -> Result:
        """Run a resource for each row of ``params`` (one run when there are none).

        A page missing from the table ends that run with ``stop_reason``; with
        ``strict`` it fails the job.
        """
        resource = self.spec.resource(name)
        spark = self.pages.sparkSession
        if params is None:
            params = spark.range(1).select(F.lit(True).alias("_run"))
        starts = frontier.start_urls(params, resource.path, self.spec.base_url)
        paging = resource.pagination
        limit = max(1, max_pages if max_pages is not None else paging.max_pages if paging else 1)
        if not resource.is_list or paging is None:
            limit = 1

        if limit == 1 and self._stored is None:
            # only the start pages are needed: pick them before the costly parse
            picked = self.pages.join(starts.select(F.col("_source").alias("url")).distinct(), "url", "left_semi")
            rows = Site(self.spec, picked, self.hooks)._rows(resource)
        else:
            rows = self._rows(resource)
            if limit > 1 and self._stored is None:
                rows = checkpoint(rows)
        known = rows.select("url", base_url(rows.columns).alias("_base"), *_page_facts(rows.columns), "_rows")
        if limit == 1:
            # the start page is the whole run: one join gives it and says whether it is there
            firsts = starts.select("_source", F.lit(0).alias("_page_no"), F.col("_source").alias("url")).distinct()
            stop = F.when(F.col("url").isNull(), F.lit(frontier.BAD_URL)).when(F.col("_read"), F.lit(frontier.MAX_PAGES))
            found = firsts.join(known, "url", "left")
            visited = found.withColumn("_stop", F.coalesce(stop, F.lit(frontier.MISSING_PAGE)))
        else:
            edges = rows.select("url", F.col("_next.url").alias("next_url"), F.col("_next.stop").alias("stop"))
            visited = frontier.walk(starts, edges, limit).join(known, "url", "left")
        return self._assemble(resource, starts, visited, strict)

    def _assemble(self, resource: Resource, starts: DataFrame, visited: DataFrame, strict: bool) -> Result:
        def build(visited: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            if strict:
                # before rows are made of the visits, so that a missing page fails the job by itself
                failure = F.raise_error(F.concat(F.lit("page not found for "), F.col("_source")))
                missing = F.col("_stop") == frontier.MISSING_PAGE
                visited = visited.withColumn("_stop", F.when(missing, failure.cast("string")).otherwise(F.col("_stop")))
            exploded = visited.select(
                "_source", "_page_no", "_stop", "_base", F.posexplode_outer("_rows").alias("_row_no", "_raw")
            )
            exploded = exploded.where(F.col("_row_no").isNotNull() & (F.coalesce("_stop", F.lit("")) != "\x00"))
            extracted = finish_rows(exploded, resource, self.hooks, ["_source", "_page_no", "_row_no"])
            data = extracted.drop("_warnings")
            warnings = extracted.select("_source", "_page_no", "_row_no", F.inline("_warnings"))
            if resource.post_process:
                hook = self.hooks.post_process.get(resource.post_process)
                if hook is not None:
                    data = hook(data, PostContext(self.spec.base_url, self.spec, resource))
                else:
                    missing = starts.select("_source").distinct().select(
                        "_source",
                        F.lit(None).cast("int").alias("_page_no"),
                        F.lit(None).cast("int").alias("_row_no"),
                        F.lit("(postProcess)").alias("field"),
                        F.lit(f'no hook named "{resource.post_process}" found').alias("message"),
                    )
                    warnings = warnings.unionByName(missing)
            return data, warnings, _meta_of(resource.name, visited)

        return Result(*build(visited), visited, build)

    @cached_property
    def names(self) -> list[str]:
        return [r.name for r in self.spec.resources]

    def create_views(self, prefix: str = "", each_page: bool = False) -> list[str]:
        """One temporary view per resource; returns their names.

        All views read one stored parse of the pages (``store`` is called unless it was).  A view
        holds the resource's run, or with ``each_page`` its rows of every page.
        """
        if self._stored is None:
            self.store()
        views = []
        for name in self.names:
            view = prefix + name.replace("-", "_")
            data = self.over_pages(name) if each_page else self.resource(name).data
            data.createOrReplaceTempView(view)
            views.append(view)
        return views


def one_capture(rows: DataFrame) -> DataFrame:
    """One row of each URL among parsed pages: the newest, then the greatest digest.

    Raw rows are small, and the later join of visits by URL needs the same exchange.
    """
    if rows.isStreaming:
        return rows
    at = F.coalesce(F.unix_micros("fetched_at"), F.lit(-(1 << 62))) if "fetched_at" in rows.columns else F.lit(0)
    others = [c for c in rows.columns if c != "url"]
    best = rows.groupBy("url").agg(F.max_by(F.struct(*others), F.struct(at, F.col("_digest"))).alias("_row"))
    return best.select("url", *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def newest_captures(pages: DataFrame) -> DataFrame:
    """One capture of each URL: the newest where the table says when they were made.

    Captures are told apart by URL, time (none is before all) and a digest of the page, which
    settles equal times; equal ones are one capture.  Which URLs have several rows is settled on
    those narrow values; only such rows are moved.  A stream is left as it is.
    """
    if pages.isStreaming:
        return pages
    at = F.coalesce(F.unix_micros("fetched_at"), F.lit(-(1 << 62))) if "fetched_at" in pages.columns else F.lit(0)
    order = F.struct(at.alias("_at"), F.xxhash64("html").alias("_digest"))
    narrow = pages.select("url", order.alias("_own"))
    best = narrow.groupBy("url").agg(F.max("_own").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    best = best.select(F.col("url").alias("_url"), "_best")
    same = F.col("url").eqNullSafe(F.col("_url"))
    single = pages.join(best, same, "left_anti")
    repeated = pages.withColumn("_own", order).join(best, same).where(F.col("_own") == F.col("_best"))
    return single.unionByName(repeated.select(*pages.columns).dropDuplicates(["url"]))


def _page_facts(columns: Iterable[str]) -> list:
    """Of a page that is known: that it is, whether it came from the cache, and when."""
    return [
        F.lit(True).alias("_read"),
        (F.col("from_cache") if "from_cache" in columns else F.lit(False)).alias("_cached"),
        (F.col("fetched_at") if "fetched_at" in columns else F.lit(None).cast("timestamp")).alias("_when"),
    ]


def run_meta(name: str, visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Per run: pages read, whether any came from the cache, when, and why it ended."""
    return _meta_of(name, visits.join(pages.select("url", *_page_facts(pages.columns)), "url", "left"))


def _meta_of(name: str, visited: DataFrame) -> DataFrame:
    return (
        visited.groupBy(F.col("_source").alias("source"))
        .agg(
            F.count("_read").cast("int").alias("pages"),
            F.coalesce(F.bool_or("_cached"), F.lit(False)).alias("from_cache"),
            F.max("_when").alias("fetched_at"),
            F.max("_stop").alias("stop_reason"),
        )
        .select(F.lit(name).alias("resource"), "source", "pages", "from_cache", "fetched_at", "stop_reason")
    )
