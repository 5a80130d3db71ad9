import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pageloom.functions.names import agent_token
from pageloom.operators import robots as rb
from pageloom.operators import snapshots as sn
from pageloom.operators.attempts import resolve_attempts
from pageloom.operators.hits import request_hits
from pageloom.operators.schedule import send_schedule
from pageloom.plans.crawl import crawl_plan
from pageloom.spec import Politeness

ROBOTS = "User-agent: *\nCrawl-delay: 8\nDisallow: /vault\n\nUser-agent: loombot\nDisallow:\n"


def allowed(spark, body, token, *paths):
    robots = spark.createDataFrame([("https://h.com", body)], "origin string, body string")
    wanted = spark.createDataFrame([("https://h.com" + p,) for p in paths], "url string")
    rows = rb.admit(wanted, rb.rulesets(rb.parse_robots(robots), token)).collect()
    found = {r.url[len("https://h.com"):]: (r.allowed, r.crawl_delay) for r in rows}
    return [found[p] for p in paths]


def test_groups_and_delay(spark):
    assert allowed(spark, ROBOTS, "snail", "/vault/key", "/lobby") == [(False, 8.0), (True, 8.0)]
    assert allowed(spark, ROBOTS, "loombot", "/vault/key") == [(True, None)]


def test_rules_meet_the_normalised_url(spark):
    ways = ["/lobby/../vault/k", "/%2e/vault", "/lobby/%2E%2e/vault?x", "\\vault"]
    assert [a for a, _ in allowed(spark, ROBOTS, "snail", *ways)] == [False] * 4
    rules = rb.rulesets(rb.parse_robots(spark.createDataFrame([("https://h.com", ROBOTS)], "origin string, body string")), "snail")
    odd = spark.createDataFrame([("HTTPS://H.com:443/vault",), ("no url",), (None,), ("mailto:a@h.com",), ("https://h.com",)], "url string")
    assert {r.url: (r.origin, r.allowed) for r in rb.admit(odd, rules).collect()} == {
        "HTTPS://H.com:443/vault": ("https://h.com", False), "no url": (None, False), None: (None, False),
        "mailto:a@h.com": (None, False), "https://h.com": ("https://h.com", True),
    }


def test_several_files_of_one_origin_need_a_time(spark):
    two = spark.createDataFrame([("o", "Allow: /", 1), ("o", "Disallow: /", 2)], "origin string, body string, fetched_at int")
    assert rb.parse_robots(two).first().field == "disallow"
    with pytest.raises(Exception, match="fetched_at"):
        rb.parse_robots(two.drop("fetched_at")).collect()


@pytest.mark.parametrize(
    "body, token, path, expected",
    [
        ("User-agent: *\nDisallow: /*.csv$", "b", "/t/u.csv", False),
        ("User-agent: *\nDisallow: /*.csv$", "b", "/t/u.csv.gz", True),
        ("User-agent: *\nAllow: /maps\nDisallow: /maps", "b", "/maps/2", True),
        ("Disallow: /x", "b", "/x", False),
        ("Disallow: /x\nUser-agent: b\nAllow: /", "b", "/x", True),
        ("User-agent: a\nUser-agent: b\nDisallow: /", "b", "/x", False),
        ("User-agent: b\n\n# note\nUser-agent: c\nDisallow: /", "b", "/x", False),
        ("User-agent: b\nSitemap: s\nUser-agent: c\nDisallow: /", "b", "/x", True),
        ("User-agent:\nAllow: /\nUser-agent: *\nDisallow: /", "b", "/x", True),
        ("User-agent: bo\nDisallow: /\nUser-agent: b\nAllow: /", "bot", "/x", False),
        ("User-agent: bot\nAllow: /\nUser-agent: bot\nDisallow: /", "bot", "/x", True),
        ("User-agent: BOT # me\r\nDISALLOW : /a?b=1", "bot", "/a?b=1&c", False),
        ("User-agent: *\nDisallow: /a$b", "bot", "/a$b", True),
        ("User-agent: *\nDisallow: /a.b", "bot", "/axb", True),
    ],
)
def test_rules(spark, body, token, path, expected):
    assert allowed(spark, body, token, path)[0][0] is expected


def test_directive_tables(spark):
    robots = spark.createDataFrame(
        [("o", "Allow: /\nUser-agent: a\nCrawl-delay: x\nCrawl-delay: 2\nCrawl-delay:\n")], "origin string, body string"
    )
    d = rb.parse_robots(robots)
    assert sorted(map(tuple, rb.agents(d).collect())) == [("o", 0, "*"), ("o", 1, "a")]
    assert [tuple(r) for r in rb.rules(d).collect()] == [("o", 0, 0, "allow", "/")]
    assert [tuple(r) for r in rb.delays(d).collect()] == [("o", 1, 0.0)]


def test_agent_token(spark):
    df = spark.createDataFrame([("My-Bot/1.0 (+x)",), ("bot (x",), ("plain",)], "ua string")
    assert [r[0] for r in df.select(agent_token(F.col("ua"))).collect()] == ["my-bot", "bot", "plain"]


def schedule_by_hand(rows):
    out, nxt = {}, {}
    for key, arrive, rid, interval in sorted(rows):
        send = max(arrive, nxt.get(key, arrive))
        out[rid] = send
        nxt[key] = send + interval
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_send_schedule(spark, hot_rows):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(0, 40_000), i) for i in range(400)]
    rows = [(k, a, i, 1000.0 if k != "k3" else 333.25) for k, a, i in rows]
    df = spark.createDataFrame(rows, "origin string, arrive_ms bigint, request_id bigint, interval_ms double")
    got = {r.request_id: r.send_ms for r in send_schedule(df, hot_rows=hot_rows, chunks=7).collect()}
    assert got == schedule_by_hand(rows)


def test_send_schedule_example(spark):
    df = spark.createDataFrame(
        [("o", t, i, 1000.0) for i, t in enumerate([0, 100, 5000, 5100])],
        "origin string, arrive_ms bigint, request_id bigint, interval_ms double",
    )
    assert [r.send_ms for r in send_schedule(df).orderBy("request_id").collect()] == [0, 1000, 5000, 6000]


def hits_by_hand(rows, ttl):
    out, last = {}, {}
    for url, t, rid in sorted(rows):
        hit = url in last and t - last[url] < ttl
        out[rid] = hit
        if not hit:
            last[url] = t
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 15])
def test_request_hits(spark, hot_rows):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(30)}", rng.randrange(0, 700), i) for i in range(500)]
    df = spark.createDataFrame(rows, "url string, ts bigint, request_id bigint")
    got = {r.request_id: r.hit for r in request_hits(df, 10, hot_rows=hot_rows, chunks=5).collect()}
    assert got == hits_by_hand(rows, 10)


def test_request_hits_keeps_urls_together(spark):
    """Ordinary URLs stay whole after the join that takes the hot ones out."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id") % 4000)).alias("url"),
        F.abs(F.xxhash64("id") % 100_000).alias("ts"),
        F.col("id").alias("request_id"),
    )
    got = {r.request_id: r.hit for r in request_hits(rows, 2_000, hot_rows=5_000, chunks=8).collect()}
    assert got == hits_by_hand([tuple(r) for r in rows.collect()], 2_000)


def test_request_hits_example(spark):
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate([0, 5, 10, 12, 25])], "url string, ts bigint, request_id bigint")
    assert [r.hit for r in request_hits(df, 10).orderBy("request_id").collect()] == [False, True, False, True, False]
    assert not any(r.hit for r in request_hits(df, 0).collect())


def test_attempts(spark):
    rows = [
        ("a", 0, 503, None), ("a", 1, 200, None),
        ("b", 0, 404, None), ("b", 1, 200, None),
        ("c", 0, 500, None), ("c", 1, None, "timeout"), ("c", 2, 502, None), ("c", 3, 200, None),
        ("d", 0, None, None), ("d", 1, None, "network-error"), ("d", 2, None, "timeout"),
    ]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, error string")
    got = {r.url: tuple(r)[1:] for r in resolve_attempts(df, 2).collect()}
    assert got == {
        "a": ("ok", 200, 2, 250, 200),
        "b": ("http-error", 404, 1, 0, 502),
        "c": ("http-error", 502, 3, 750, 502),
        "d": ("timeout", None, 3, 750, 502),
    }


def snapshot_rows(spark, rows):
    df = spark.createDataFrame(rows, "url string, body string, ms bigint")
    return df.select("url", F.lit(None).cast("string").alias("final_url"), "body", F.timestamp_millis("ms").alias("stored_at"))


def test_snapshots(spark):
    base = snapshot_rows(spark, [("a", "a0", 100), ("b", "b0", 500), ("c", "c0", 10)])
    new = snapshot_rows(spark, [("a", "a1", 100), ("b", "b1", 400), ("d", "d1", 1), ("d", "d2", 2)])
    merged = {r.url: r.body for r in sn.upsert(base, new).collect()}
    assert merged == {"a": "a1", "b": "b0", "c": "c0", "d": "d2"}
    wanted = spark.createDataFrame([("a",), ("b",), ("x",)], "url string")
    served, missing = sn.split_wanted(wanted, base, 600, 500)
    assert [r.url for r in served.collect()] == ["b"]
    assert sorted(r.url for r in missing.collect()) == ["a", "x"]
    assert [(r.url, r.html, r.from_cache) for r in sn.serve(wanted, base, 600, 500).collect()] == [("b", "b0", True)]
    assert sn.split_wanted(wanted, base, 600, 0)[0].count() == 0


def test_latest_without_times(spark):
    rows = snapshot_rows(spark, [("a", "a0", None), ("a", "a1", None), ("b", "b0", None), ("b", "b1", 3)])
    kept = {r.url: r.body for r in sn.latest(rows).collect()}
    assert kept["a"] in ("a0", "a1") and kept["b"] == "b1"
    assert {r.url: r.body for r in sn.latest(rows.orderBy(F.desc("body"))).collect()} == kept
    assert {r.url: r.body for r in sn.upsert(snapshot_rows(spark, [("a", "old", 1)]), rows).collect()} == {"a": "old", "b": "b1"}


def test_hits_of_fractions_are_refused(spark):
    with pytest.raises(TypeError):
        request_hits(spark.createDataFrame([("u", 0.5, 1)], "url string, ts double, request_id bigint"), 10)


def test_crawl_plan(spark):
    h = "https://h.com"
    wanted = spark.createDataFrame(
        [(1, f"{h}/vault/1", 0), (2, f"{h}/a", 0), (3, f"{h}/b", 0), (4, f"{h}/a", 5), (5, "https://n.com/x", 7), (6, f"{h}/vault/2", 0),
         (7, f"{h}/c", 9000), (8, None, 1), (9, "no url", 1), (10, f"{h}/vault/1", 99_500), (11, f"{h}/d", 10), (12, f"{h}/d", 60_000), (13, f"{h}/d", 150_000)],
        "request_id bigint, url string, arrive_ms bigint",
    )
    copies = snapshot_rows(spark, [(f"{h}/vault/1", "x", 1000), (f"{h}/d", "y", -50_000), (f"{h}/d", "old", -90_000)])
    robots = spark.createDataFrame([(h, ROBOTS)], "origin string, body string")

    def actions(ttl, **more):
        plan = crawl_plan(wanted, copies, robots, Politeness(cache_ttl_ms=ttl), 2000, **more)
        return {r.request_id: (r.action, r.send_ms) for r in plan.collect()}

    expected = {
        1: ("cached", None), 2: ("send", 0.0), 3: ("send", 8000.0), 4: ("cached", None), 5: ("send", 7.0), 6: ("blocked", None),
        7: ("send", 16000.0), 8: ("invalid", None), 9: ("invalid", None), 10: ("blocked", None),
        # the copy of /d is 52 s old at the start: it serves until 48 s, the fetch at 60 s until 160 s
        11: ("cached", None), 12: ("send", 60000.0), 13: ("cached", None),
    }
    assert actions(100_000) == expected
    assert actions(100_000, hot_rows=1) == expected
    assert {k for k, v in actions(0).items() if v[0] == "send"} == {2, 3, 4, 5, 7, 11, 12, 13}


def test_crawl_plan_of_null_and_repeated_ids(spark):
    """Every request comes back once; equal times go in order of id, a null id first."""
    h = "https://h.com"
    wanted = spark.createDataFrame(
        [(None, f"{h}/a", 0), (1, f"{h}/a", 0), (2, f"{h}/b", 0), (2, f"{h}/b", 50), (-3, f"{h}/c", 9), (4, f"{h}/c", 9), (None, None, 1)],
        "request_id bigint, url string, arrive_ms bigint",
    )
    copies = snapshot_rows(spark, [(f"{h}/z", "x", 1000)])
    robots = spark.createDataFrame([(h, "")], "origin string, body string")
    for more in ({}, {"hot_rows": 1}):
        plan = crawl_plan(wanted, copies, robots, Politeness(cache_ttl_ms=1000), 2000, **more)
        assert sorted(((r.url or "")[-1:], r.request_id or 0, r.arrive_ms, r.action) for r in plan.collect()) == [
            ("", 0, 1, "invalid"), ("a", 0, 0, "send"), ("a", 1, 0, "cached"), ("b", 2, 0, "send"), ("b", 2, 50, "cached"),
            ("c", -3, 9, "send"), ("c", 4, 9, "cached"),
        ]


def test_busy_keys_are_split(spark):
    """Lowered thresholds: the skew join takes a busy origin and a busy URL apart."""
    rows = spark.range(40_000).select(
        F.col("id").alias("request_id"), F.concat(F.lit("https://h.com/p"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500)).alias("url")
    ).repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        robots = spark.createDataFrame([("https://h.com", ROBOTS)], "origin string, body string")
        admitted = rb.admit(rows, rb.rulesets(rb.parse_robots(robots), "snail"))
        admitted.collect()
        assert "skew=true" in admitted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_many_rules(spark):
    """A file of 5,000 rules: verdicts of plain trials of all rules, in far less than their time."""
    rng = random.Random(6)
    parts = ["a", "b", "ab", "ba", "é", "x%20y", "*", "b*", "a$", "c.html$"]
    rules = {("Allow" if rng.random() < 0.4 else "Disallow", "/" + "/".join(rng.choice(parts[: 10 if rng.random() < 0.05 else 5]) for _ in range(rng.randint(1, 7)))) for _ in range(9000)}
    rules = sorted(rules)[:5000]
    body = "User-agent: *\n" + "\n".join(f"{kind}: {path}" for kind, path in rules)
    robots = spark.createDataFrame([("https://h.com", body), ("https://e.com", "User-agent: *\nDisallow:\n"), ("https://n.com", "User-agent: z\nDisallow: /")], "origin string, body string")
    paths = ["/" + "/".join(rng.choice(parts[:4] + ["c.html", "xa"]) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    wanted = spark.createDataFrame([(f"https://{host}.com{p}",) for p in paths for host in ("h", "e", "n")], "url string").distinct()

    def verdict(path):
        size = {"Allow": -1, "Disallow": -1}
        for kind, pattern in rules:
            if "*" in pattern or "$" in pattern:
                hit = re.match("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\$", r"\Z"), path)
            else:
                hit = path.startswith(pattern)
            if hit:
                size[kind] = max(size[kind], len(pattern))
        return size["Disallow"] < 0 or size["Allow"] >= size["Disallow"]

    started = time.perf_counter()
    got = {r.url: r.allowed for r in rb.admit(wanted, rb.rulesets(rb.parse_robots(robots), "snail")).collect()}
    assert time.perf_counter() - started < 60
    assert all(v for u, v in got.items() if not u.startswith("https://h"))
    chosen = rng.sample(sorted(set(paths)), 400)
    expected = {p: verdict(p) for p in chosen}
    assert len(set(expected.values())) == 2
    assert {p: got["https://h.com" + p] for p in chosen} == expected
