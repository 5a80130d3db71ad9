"""Crawl planning over the pages and events tables.

The sample tables hold no robots files, snapshots or attempt log; they are derived
from page URLs and events by the same SQL expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import attempts as at
from pageloom.operators import robots as rb
from pageloom.operators import snapshots as sn
from pageloom.operators.hits import request_hits as mark_hits
from pageloom.operators.schedule import send_schedule as schedule
from pageloom.plans.crawl import crawl_plan as plan
from pageloom.plans.registry import query
from pageloom.plans.tables import longs, table
from pageloom.session import scratch_path
from pageloom.sources.cache import read_cache_folder, write_cache_folder
from pageloom.sources.store import SnapshotStore
from pageloom.spec import Politeness
from pageloom.streaming.jobs import start_hits, start_snapshots, stream_pages

NOW_MS = 1_704_067_200_000
TTL_MS = 600_000
AGENT = "LoomBot/1.0 (+https://example.com)"
POLITENESS = Politeness(requests_per_second=4, cache_ttl_ms=TTL_MS, user_agent=AGENT)

# A robots file per origin, in SQL that both engines read.
ROBOTS_BODY = """
    concat('# robots of ', origin, chr(10), 'Disallow: /first', chr(13), chr(10), chr(10), 'User-agent: *', chr(10),
      'Disallow: /fr/', chr(10), 'Allow: /fr/1*', chr(10), 'Crawl-delay: ', length(origin) % 4, chr(10), chr(10),
      'no colon here', chr(10), 'User-agent: loom', chr(10), 'User-Agent: Other-Bot # two agents', chr(10),
      case when length(origin) % 2 = 0 then 'Disallow: /*.html$' else 'Disallow:' end, chr(10),
      'Disallow: /de/', chr(10), 'Allow : /de/', chr(10), 'crawl-delay: x', chr(10),
      'Crawl-delay: 2', chr(10), 'Disallow: /en/9', chr(10),
      case when length(origin) % 5 = 0
           then concat('User-agent: loombot', chr(10), 'Disallow: /es', chr(10), 'Crawl-delay:', chr(10), 'Allow: /es/*5') else '' end)
"""
# Origins whose length is a multiple of 7 have no robots file.
ROBOTS_SQL = f"""
robots as (
  select origin, {ROBOTS_BODY} as body from
    (select distinct regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin from pages) where length(origin) % 7 <> 0),
lines as (
  select origin, unnest(range(len(string_split(body, chr(10))))) as line_no,
         trim(regexp_replace(replace(unnest(string_split(body, chr(10))), chr(13), ''), '#.*', '')) as line
  from robots),
parsed as (
  select origin, line_no, lower(trim(split_part(line, ':', 1))) as field,
         trim(substr(line, strpos(line, ':') + 1)) as raw
  from lines where strpos(line, ':') > 0),
marked as (
  select *, case when field = 'user-agent' and coalesce(lag(field) over w, '') <> 'user-agent' then 1 else 0 end as opens
  from parsed window w as (partition by origin order by line_no)),
directives as (
  select origin, line_no, sum(opens) over (partition by origin order by line_no)::bigint as group_id, field,
         case when field = 'user-agent' then lower(raw) else raw end as value
  from marked),
agents as (
  select origin, group_id, value as agent from directives where field = 'user-agent'
  union select origin, 0, '*' from directives where group_id = 0),
chosen as (
  select origin, group_id from agents where agent = '*' or starts_with('loombot', agent)
  qualify row_number() over (partition by origin order by agent = '*', -length(agent), group_id) = 1),
delay as (
  select origin, arg_max(case when value = '' then 0.0::double else value::double end, line_no) as crawl_delay
  from directives join chosen using (origin, group_id)
  where field = 'crawl-delay' and value <> 'x' group by origin),
rule as (
  select origin, field as kind, value as pattern,
         '^' || replace(replace(value, '.', '[.]'), '*', '.*') as rx
  from directives join chosen using (origin, group_id) where field in ('allow', 'disallow') and value <> '')
"""
ADMIT_SQL = """
located as (
  select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin,
         regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path from pages),
admitted as (
  select page_id, url, l.origin, crawl_delay,
         coalesce(max(case when kind = 'disallow' and regexp_matches(path, rx) then length(pattern) end), -1) as d,
         coalesce(max(case when kind = 'allow' and regexp_matches(path, rx) then length(pattern) end), -1) as a
  from located l left join rule r on l.origin = r.origin left join delay on l.origin = delay.origin
  group by page_id, url, l.origin, crawl_delay)
"""


def robots_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin")
    ).distinct()
    return origins.where("length(origin) % 7 <> 0").selectExpr("origin", f"{ROBOTS_BODY} as body")


def page_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth page has a copy, older the later its number."""
    return table(spark, sf_dir, "pages").where("page_id % 4 = 0").select(
        "url",
        F.col("url").alias("final_url"),
        F.col("html").alias("body"),
        F.timestamp_millis(F.lit(NOW_MS) - F.col("page_id") * 10_000).alias("stored_at"),
    )


COPIES_SQL = f"(select url, page_id, {NOW_MS} - page_id * 10000 as stored_ms from pages where page_id % 4 = 0)"


def wanted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for pages, one per event of the user with the page's number."""
    known = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "user_id", (F.unix_millis("ts") % 7_200_000).alias("arrive_ms")
    )
    return log.join(known, "user_id").select("request_id", "url", "arrive_ms")


WANTED_SQL = """
wanted as (select event_id as request_id, url, (epoch_us(ts) // 1000) % 7200000 as arrive_ms from events join pages on user_id = page_id)
"""

# ---- snapshots ------------------------------------------------------------------


@query(
    f"select event_id, {NOW_MS} + 86400000 - (epoch_us(ts) // 1000) < 43200000 as fresh, false as never from events"
)
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.unix_millis("ts")
    now = NOW_MS + 86_400_000
    return table(spark, sf_dir, "events").select(
        "event_id",
        sn.is_fresh(now, stored, 43_200_000).alias("fresh"),
        sn.is_fresh(now, F.lit(now), 0).alias("never"),
    )


@query(
    f"""
    with {WANTED_SQL}
    select request_id, w.url, coalesce({NOW_MS} - stored_ms < {TTL_MS}, false) as served
    from wanted w left join {COPIES_SQL} c on w.url = c.url
    """
)
def ttl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    served, missing = sn.split_wanted(
        wanted_urls(spark, sf_dir), page_copies(spark, sf_dir), NOW_MS, TTL_MS
    )
    return served.withColumn("served", F.lit(True)).unionByName(missing.withColumn("served", F.lit(False))).select(
        "request_id", "url", "served"
    )


@query(
    f"""
    with {WANTED_SQL}
    select request_id, w.url, md5(html) as body, stored_ms, true as from_cache
    from wanted w join {COPIES_SQL} c on w.url = c.url join pages p on p.url = w.url
    where {NOW_MS} - stored_ms < {TTL_MS}
    """
)
def served_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sn.serve(wanted_urls(spark, sf_dir), page_copies(spark, sf_dir), NOW_MS, TTL_MS)
    return found.select(
        "request_id", "url", F.md5("html").alias("body"), F.unix_millis("fetched_at").alias("stored_ms"), "from_cache"
    )


@query(
    """
    select 'u' || user_id as url, arg_max(event_type, ts) as body, (epoch_us(max(ts)) // 1000) as stored_ms from events group by user_id
    """
)
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("url"),
        F.col("event_type").alias("body"),
        F.col("ts").alias("stored_at"),
        "event_id",
    )
    base = sn.latest(copies.where("event_id % 3 <> 0").drop("event_id"))
    merged = sn.upsert(base, copies.where("event_id % 3 = 0").drop("event_id"))
    return merged.select("url", "body", F.unix_millis("stored_at").alias("stored_ms"))


@query("select url, md5(html || ((5 - page_id % 3) % 3)) as body, page_id + 2 as age from pages")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of every page, in three batches; which is the newest differs by page."""
    source, path = scratch_path(spark, "copies"), scratch_path(spark, "snapshots")
    known = table(spark, sf_dir, "pages")
    for version in (2, 0, 1):
        known.select(
            "url",
            F.col("url").alias("final_url"),
            F.concat("html", F.lit(str(version))).alias("body"),
            F.timestamp_seconds(F.col("page_id") + (F.col("page_id") + version) % 3).alias("stored_at"),
        ).write.mode("append").parquet(source)
    copies = stream_pages(spark, source, "url string, final_url string, body string, stored_at timestamp", 1)
    start_snapshots(copies, path, path + "-log", availableNow=True).awaitTermination()
    stored = SnapshotStore(spark, path).read()
    return stored.select("url", F.md5("body").alias("body"), F.unix_seconds("stored_at").alias("age"))


# four captures of every page at times that differ, the one or other without a time, dealt over six batches
CAPTURED_MS = f"{NOW_MS} - (page_id * 7 + c * 13) % 50 * 1000"


@query(
    f"""
    with copies as (
      select url, page_id, md5(html || '<!-- ' || c || ' -->') as body,
             case when (page_id + c) % 9 <> 0 then {CAPTURED_MS} end as stored_ms from pages cross join range(4) t(c))
    select url, 'https://final.example/' || page_id as final_url, body, stored_ms, page_id % 5 = 0 as asked
    from copies qualify row_number() over (partition by url order by stored_ms desc nulls last) = 1
    """
)
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that arrive out of order in six batches, two merges between; some URLs read by themselves."""
    captures = table(spark, sf_dir, "pages").withColumn("c", F.explode(F.array(*map(F.lit, range(4)))))
    at = F.timestamp_millis(F.expr(CAPTURED_MS))
    copies = captures.select(
        "url",
        F.concat(F.lit("https://final.example/"), F.col("page_id")).alias("final_url"),
        F.concat("html", F.lit("<!-- "), F.col("c"), F.lit(" -->")).alias("body"),
        F.when((F.col("page_id") + F.col("c")) % 9 != 0, at).alias("stored_at"),
        ((F.col("page_id") + F.col("c") * F.col("c")) % 6).alias("part"),
    )
    store = SnapshotStore(spark, scratch_path(spark, "store"), merge_every=2, buckets=4)
    for part in range(6):
        store.append(copies.where(F.col("part") == part).drop("part"))
    asked = table(spark, sf_dir, "pages").where("page_id % 5 = 0").select("url")
    parts = [
        store.read(wanted=asked).withColumn("asked", F.lit(True)),
        store.read().join(asked, "url", "left_anti").withColumn("asked", F.lit(False)),
    ]
    both = parts[0].unionByName(parts[1])
    return both.select("url", "final_url", F.md5("body").alias("body"), F.unix_millis("stored_at").alias("stored_ms"), "asked")


# ---- robots -----------------------------------------------------------------------


@query(f"with {ROBOTS_SQL} select origin, line_no, group_id, field, value from directives")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(rb.parse_robots(robots_table(spark, sf_dir)))


@query(
    f"with {ROBOTS_SQL} select origin, group_id, agent, (select count(*) from directives d where d.origin = a.origin"
    " and d.group_id = a.group_id and field in ('allow', 'disallow')) as n_rules from agents a"
)
def robots_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    directives = rb.parse_robots(robots_table(spark, sf_dir))
    counts = rb.rules(directives).groupBy("origin", "group_id").agg(F.count("*").alias("n_rules"))
    joined = rb.agents(directives).join(counts, ["origin", "group_id"], "left")
    return longs(joined.fillna({"n_rules": 0}))


@query(
    f"""
    with {ROBOTS_SQL}
    select origin, group_id, crawl_delay, count(*) filter (kind = 'allow') as n_allow, count(*) filter (kind = 'disallow') as n_disallow
    from chosen left join delay using (origin) left join rule using (origin) group by origin, group_id, crawl_delay
    """
)
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, rules and delay that apply to one agent, per origin."""
    chosen = rb.rulesets(rb.parse_robots(robots_table(spark, sf_dir)), "loombot")
    return longs(
        chosen.select(
            "origin", "group_id", "crawl_delay", F.size("allow").alias("n_allow"), F.size("disallow").alias("n_disallow")
        )
    )


@query(
    f"""
    with {ROBOTS_SQL}
    select origin, group_id, arg_max(case when value = '' then 0.0::double else value::double end, line_no) as crawl_delay
    from directives where field = 'crawl-delay' and value <> 'x' group by origin, group_id
    """
)
def robots_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(rb.delays(rb.parse_robots(robots_table(spark, sf_dir))))


@query(f"with {ROBOTS_SQL}, {ADMIT_SQL} select page_id, origin, crawl_delay, d < 0 or a >= d as allowed from admitted")
def robots_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rb.rulesets(rb.parse_robots(robots_table(spark, sf_dir)), "loombot")
    wanted = table(spark, sf_dir, "pages").select("page_id", "url")
    return rb.admit(wanted, rules).select("page_id", "origin", "crawl_delay", "allowed")


@query(f"with {ROBOTS_SQL}, {ADMIT_SQL} select page_id, origin, crawl_delay, d < 0 or a >= d as allowed from admitted")
def robots_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts for the same URLs written with dot segments and an upper-case host."""
    rules = rb.rulesets(rb.parse_robots(robots_table(spark, sf_dir)), "loombot")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rest = F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    scheme = F.regexp_extract("url", "^([a-z]+):", 1)
    detour = F.when(F.col("page_id") % 2 == 0, F.lit("/x/..")).otherwise(F.lit("/a/%2e/b/%2E%2e/.."))
    written = table(spark, sf_dir, "pages").select("page_id", F.concat(scheme, F.lit("://"), F.upper(host), detour, rest).alias("url"))
    return rb.admit(written, rules).select("page_id", "origin", "crawl_delay", "allowed")


# ---- schedules and logs --------------------------------------------------------------


@query(
    """
    select event_id, origin, rn * i + max(arrive_ms - rn * i) over (partition by origin order by arrive_ms, event_id) as send_ms
    from (select event_id, 'o' || user_id % 40 as origin, (epoch_us(ts) // 1000) as arrive_ms, 250.0::double * (1 + user_id % 40) as i,
                 row_number() over (partition by user_id % 40 order by (epoch_us(ts) // 1000), event_id) as rn from events)
    """
)
def send_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("user_id") % 40
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("o"), group).alias("origin"),
        F.unix_millis("ts").alias("arrive_ms"),
        (250.0 * (1 + group)).alias("interval_ms"),
    )
    return schedule(requests).select(F.col("request_id").alias("event_id"), "origin", "send_ms")


PLAN_SQL = f"""
    with recursive {ROBOTS_SQL}, {ADMIT_SQL}, {WANTED_SQL},
    asked as (
      select request_id, arrive_ms, case when request_id % 89 = 0 then null when request_id % 97 = 0 then 'no url' else url end as url from wanted),
    log as (
      select request_id, a.url, arrive_ms, origin, stored_ms - {NOW_MS} as stored, greatest(250.0::double, coalesce(crawl_delay, 0) * 1000) as i,
             case when origin is null then 'invalid' when not (d < 0 or a >= d) then 'blocked' else 'send' end as else_do,
             row_number() over (partition by a.url order by arrive_ms, request_id) as rn
      from asked a left join admitted on a.url = admitted.url left join {COPIES_SQL} c on c.url = a.url),
    fold as (
      select request_id, url, rn, coalesce(arrive_ms - stored < {TTL_MS}, false) as hit,
             case when else_do = 'send' and not coalesce(arrive_ms - stored < {TTL_MS}, false) then arrive_ms else stored end as last_fetch
      from log where rn = 1 and url is not null
      union all
      select l.request_id, l.url, l.rn, coalesce(l.arrive_ms - f.last_fetch < {TTL_MS}, false),
             case when l.else_do = 'send' and not coalesce(l.arrive_ms - f.last_fetch < {TTL_MS}, false) then l.arrive_ms else f.last_fetch end
      from fold f join log l on l.url = f.url and l.rn = f.rn + 1),
    decided as (
      select l.request_id, l.url, arrive_ms, origin, i, case when coalesce(hit, false) then 'cached' else else_do end as action
      from log l left join fold f using (request_id)),
    slots as (
      select request_id, i, row_number() over o as rn, arrive_ms, origin from decided where action = 'send'
      window o as (partition by origin order by arrive_ms, request_id)),
    sends as (
      select request_id, rn * i + max(arrive_ms - rn * i) over (partition by origin order by arrive_ms, request_id) as send_ms
      from slots)
    select request_id, url, arrive_ms, origin, action, send_ms from decided left join sends using (request_id)
"""


def asked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted URLs, some of them missing or not web URLs."""
    wanted = wanted_urls(spark, sf_dir)
    odd = F.when(F.col("request_id") % 89 == 0, F.lit(None)).when(F.col("request_id") % 97 == 0, F.lit("no url"))
    return wanted.withColumn("url", F.when((F.col("request_id") % 89 == 0) | (F.col("request_id") % 97 == 0), odd).otherwise(F.col("url")))


@query(
    f"""
    select url, url || '?final' as final_url, md5(html) as body, {NOW_MS} - page_id * 977 as stored_ms
    from pages where page_id % 4 <> 1 and page_id % 10 <> 3
    """
)
def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache files written from the pages and read by name: some missing, some broken, some of other URLs."""
    known = table(spark, sf_dir, "pages")
    entry = F.to_json(
        F.struct(
            F.concat("url", F.lit("?final")).alias("finalUrl"), F.col("html").alias("body"), (F.lit(NOW_MS) - F.col("page_id") * 977).alias("storedAt")
        )
    )
    broken = F.when(F.col("page_id") % 10 == 3, F.substring(entry, 1, 200)).otherwise(entry)
    stored = known.where("page_id % 4 <> 1").select(F.col("url"), broken.alias("entry"))
    stored = stored.unionByName(stored.select(F.concat(F.lit("other "), "url").alias("url"), "entry"))
    folder = write_cache_folder(stored, scratch_path(spark, "cache"))
    found = read_cache_folder(spark, folder, known.select("url"))
    return found.select("url", "final_url", F.md5("body").alias("body"), F.unix_millis("stored_at").alias("stored_ms"))


@query(PLAN_SQL)
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(
        asked_urls(spark, sf_dir), page_copies(spark, sf_dir), robots_table(spark, sf_dir), POLITENESS, NOW_MS
    )


@query(PLAN_SQL)
def crawl_plan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan with every larger origin and URL cut into chunks."""
    return plan(
        asked_urls(spark, sf_dir), page_copies(spark, sf_dir), robots_table(spark, sf_dir), POLITENESS, NOW_MS, hot_rows=12
    )


ATTEMPT_SQL = "[503, 200, 404, 502, null, 301, 500][(event_id * 5 + attempt * 3) % 7 + 1]"


@query(
    f"""
    with log as (
      select event_id, attempt, {ATTEMPT_SQL} as status from events cross join range(4) t(attempt) where attempt <= 2),
    final as (select event_id, min(attempt) as attempt from log where status < 500 group by event_id),
    last as (select event_id, coalesce(final.attempt, 2) as attempt from events left join final using (event_id))
    select event_id, status::bigint as status, attempt + 1 as attempts,
           case when status is null then 'timeout' when status = 200 then 'ok' else 'http-error' end as outcome,
           (250 * (2 ** attempt - 1))::bigint as wait_ms, case when status = 200 then 200 else 502 end::bigint as http_status
    from last join log using (event_id, attempt)
    """
)
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.array(*[F.lit(s).cast("int") for s in (503, 200, 404, 502, None, 301, 500)])
    log = table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    log = log.select(
        "event_id",
        "attempt",
        F.get(statuses, ((F.col("event_id") * 5 + F.col("attempt") * 3) % 7).cast("int")).alias("status"),
        F.lit("timeout").alias("error"),
    )
    return longs(at.resolve_attempts(log, max_retries=2, keys=["event_id"]))


@query(
    f"""
    with {ROBOTS_SQL}, {ADMIT_SQL},
    log as (select page_id, attempt, {ATTEMPT_SQL.replace("event_id", "page_id")} as status from pages cross join range(3) t(attempt)),
    final as (select page_id, min(attempt) as attempt from log where status < 500 group by page_id),
    told as (select page_id, status from (select page_id, coalesce(final.attempt, 2) as attempt from pages left join final using (page_id)) join log using (page_id, attempt))
    select page_id, case when not (d < 0 or a >= d) then 403 when status = 200 then 200 else 502 end::bigint as http_status
    from told join admitted using (page_id)
    """
)
def answer_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller is told of every page: 403 where robots forbid it, else by its attempts."""
    rules = rb.rulesets(rb.parse_robots(robots_table(spark, sf_dir)), "loombot")
    verdicts = rb.admit(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    statuses = F.array(*[F.lit(s).cast("int") for s in (503, 200, 404, 502, None, 301, 500)])
    log = verdicts.where("allowed").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    status = F.get(statuses, ((F.col("page_id") * 5 + F.col("attempt") * 3) % 7).cast("int"))
    tried = at.resolve_attempts(log.select("page_id", "attempt", status.alias("status"), F.lit("timeout").alias("error")), 2, ["page_id"])
    outcome = F.coalesce("outcome", F.lit(at.ROBOTS))
    answers = verdicts.join(tried.select("page_id", "outcome"), "page_id", "left")
    return longs(answers.select("page_id", at.http_status(outcome).alias("http_status")))


HITS_SQL = """
    with recursive log as (
      select event_id, user_id, (epoch_us(ts) // 1000) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    fold as (
      select user_id, rn, event_id, false as hit, t as last_fetch from log where rn = 1
      union all
      select l.user_id, l.rn, l.event_id, l.t - f.last_fetch < 3600000, case when l.t - f.last_fetch < 3600000 then f.last_fetch else l.t end
      from fold f join log l on l.user_id = f.user_id and l.rn = f.rn + 1)
    select event_id, user_id, hit from fold
"""


@query(HITS_SQL)
def request_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis("ts").alias("ts"))
    marked = mark_hits(log, 3_600_000, key="user_id", at="ts", tie="event_id")
    return marked.select("event_id", "user_id", "hit")


@query(HITS_SQL)
def request_hits_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits with the users of many requests resolved in chunks."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis("ts").alias("ts"))
    marked = mark_hits(log, 3_600_000, key="user_id", at="ts", tie="event_id", hot_rows=12)
    return marked.select("event_id", "user_id", "hit")


def _hits_of(spark: SparkSession, requests: DataFrame, batches: int, **options) -> DataFrame:
    """Hits of ``requests`` (url, request_id, ts, part) as a stream of ``batches`` parts.

    Every part is written by all its tasks into files of the same number, so that a
    trigger takes just one part.
    """
    source, out = scratch_path(spark, "requests"), scratch_path(spark, "hits")
    files = spark.sparkContext.defaultParallelism
    columns = ["url", "request_id", "ts"]
    for part in range(batches):
        rows = requests.where(F.col("part") == part).select(*columns)
        # a file for each task, empty ones too: the range of a generated id deals them out evenly
        numbered = spark.range(0, files, 1, files).select(F.col("id").cast("int").alias("_to"))
        dealt = rows.withColumn("_to", F.pmod(F.xxhash64("request_id"), F.lit(files)).cast("int"))
        dealt = dealt.unionByName(numbered, allowMissingColumns=True).repartitionById(files, F.col("_to"))
        dealt.select(*columns, F.col("request_id").isNull().alias("filler")).write.mode("append").parquet(source)
    schema = "url string, request_id bigint, ts timestamp, filler boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    real = stream.where("not filler").drop("filler")
    start_hits(real, 3_600_000, out, out + "-log", availableNow=True, **options).awaitTermination()
    return spark.read.parquet(out + "/hits").select(
        F.col("request_id").alias("event_id"), F.col("url").cast("bigint").alias("user_id"), "hit"
    )


def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("request_id"), "ts")


@query(HITS_SQL)
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits of a request stream in one batch."""
    return _hits_of(spark, _event_requests(spark, sf_dir).withColumn("part", F.lit(0)), 1)


@query(HITS_SQL)
def stream_hits_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits over four batches in order of time, with the state between them in tables."""
    requests = _event_requests(spark, sf_dir)
    at = F.unix_micros("ts")
    cuts = requests.select(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("c")).first()["c"] or []
    part = sum((F.coalesce(at > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return _hits_of(spark, requests.withColumn("part", part), 4, merge_every=3)


# requests by id, not time, into eight batches; every 31st has no time
LATE_SQL = """
    with recursive log as (
      select event_id, user_id, case when event_id % 31 <> 0 then epoch_us(ts) // 1000 end as t, event_id * 7 // 13 % 8 as part from events),
    turns as (select *, row_number() over (partition by user_id order by part, t nulls first, event_id) as rn from log),
    fold as (
      select user_id, rn, event_id, part, t, false as hit, cast(null as bigint) as old, t as last_fetch from turns where rn = 1
      union all
      select user_id, rn, event_id, part, t, coalesce(t < known + 3600000 or t - last < 3600000, false),
             known, case when t is null or coalesce(t < known + 3600000 or t - last < 3600000, false) then last else t end
      from (select l.user_id, l.rn, l.event_id, l.part, l.t, f.last_fetch as last,
                   case when l.part = f.part then f.old else f.last_fetch end as known
            from fold f join turns l on l.user_id = f.user_id and l.rn = f.rn + 1))
    select event_id, user_id, hit from fold
"""


@query(LATE_SQL)
def stream_hits_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over eight batches whose times overlap, some requests without a time, with two merges of the state.

    Within a batch requests go by time; a batch is judged by the fetches of those before it.
    """
    requests = _event_requests(spark, sf_dir)
    timed = requests.withColumn("ts", F.when(F.col("request_id") % 31 != 0, F.col("ts")))
    part = F.floor(F.col("request_id") * 7 / 13).cast("bigint") % 8
    return _hits_of(spark, timed.withColumn("part", part), 8, merge_every=3, buckets=4, keep_ms=1 << 50)
