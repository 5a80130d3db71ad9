"""Robots files as tables: parse, choose a group, admit or block URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.cols import fields, sql_call, sql_fields, sql_let
from pageloom.functions.text import trim

AGENT, ALLOW, DISALLOW, DELAY = "user-agent", "allow", "disallow", "crawl-delay"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_robots(robots: DataFrame) -> DataFrame:
    """``origin, line_no, group_id, field, value`` for every meaningful line.

    Consecutive user-agent lines open one group together; any other field ends the
    run.  Group 0 holds what stands before the first user-agent line and speaks for
    every agent.  An origin has one file; several copies need a ``fetched_at`` column,
    and the newest counts.  So an origin's lines come from one text cell, which bounds
    the window; its shuffle by origin is the aggregate's.
    """
    if "fetched_at" in robots.columns:
        newest = F.max_by("body", "fetched_at")
    else:
        several = F.raise_error(F.concat(F.lit("several robots files without fetched_at: "), F.first("origin")))
        newest = F.when(F.count_distinct("body") > 1, several.cast("string")).otherwise(F.max("body"))
    single = robots.groupBy("origin").agg(newest.alias("body"))
    lines = single.select(
        "origin", F.posexplode(F.split("body", "\r?\n")).alias("line_no", "_line")
    ).select("origin", "line_no", trim(F.regexp_replace("_line", "(?s)#.*$", "")).alias("_line"))
    colon = F.instr("_line", ":")
    parsed = lines.where(colon > 0).select(
        "origin",
        "line_no",
        F.lower(trim(F.substring_index("_line", ":", 1))).alias("field"),
        trim(F.regexp_extract("_line", "(?s)^[^:]*:(.*)$", 1)).alias("value"),
    )
    ordered = W.partitionBy("origin").orderBy("line_no")
    is_agent = F.col("field") == AGENT
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(ordered), F.lit(False))
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    return (
        parsed.withColumn("_opens", opens.cast("int"))
        .withColumn("group_id", F.sum("_opens").over(running).cast("int"))
        .select(
            "origin",
            "line_no",
            "group_id",
            "field",
            F.when(is_agent, F.lower("value")).otherwise(F.col("value")).alias("value"),
        )
    )


def agents(directives: DataFrame) -> DataFrame:
    named = directives.where(F.col("field") == AGENT).select("origin", "group_id", F.col("value").alias("agent"))
    implied = directives.where("group_id = 0").select("origin", "group_id", F.lit("*").alias("agent"))
    return named.unionByName(implied.distinct())


def rules(directives: DataFrame) -> DataFrame:
    return directives.where(F.col("field").isin(ALLOW, DISALLOW)).select(
        "origin", "group_id", "line_no", F.col("field").alias("kind"), F.col("value").alias("pattern")
    )


def _delay(value: Column) -> Column:
    """Seconds; an empty value counts as 0, anything else must be a number."""
    return F.when(value == "", F.lit(0.0)).when(value.rlike(NUMBER), value.try_cast("double"))


def delays(directives: DataFrame) -> DataFrame:
    """The last numeric delay of every group."""
    seconds = _delay(F.col("value"))
    return (
        directives.where((F.col("field") == DELAY) & seconds.isNotNull())
        .groupBy("origin", "group_id")
        .agg(F.max_by(seconds, F.col("line_no")).alias("crawl_delay"))
    )


def rulesets(directives: DataFrame, token: str) -> DataFrame:
    """One row per origin: the group chosen for ``token`` with its compiled rules and delay.

    The longest agent that starts the token wins, then the first ``*`` group; equal
    agents are not merged.  Origins without a matching group have no row.  Everything
    is keyed by origin, so the shuffle of :func:`parse_robots` serves here too.
    """
    agent = F.col("value")
    named = (F.col("field") == AGENT) & (agent != "*") & F.startswith(F.lit(token), agent)
    star = ((F.col("field") == AGENT) & (agent == "*")) | (F.col("group_id") == 0)
    rank = F.when(
        named, fields(star=F.lit(1), rest=-F.length(agent), group=F.col("group_id"))
    ).when(star, fields(star=F.lit(2), rest=F.lit(0), group=F.col("group_id")))
    # group 0 has no agent line of its own, so a named agent can never point at it
    chosen = F.min(rank).over(W.partitionBy("origin"))["group"]
    in_group = directives.withColumn("_chosen", chosen).where("_chosen = group_id")
    rule = compile_rule(F.col("value"))
    seconds = _delay(F.col("value"))
    return in_group.groupBy("origin").agg(
        F.min("group_id").alias("group_id"),
        F.collect_list(F.when(F.col("field") == ALLOW, rule)).alias("allow"),
        F.collect_list(F.when(F.col("field") == DISALLOW, rule)).alias("disallow"),
        F.max_by(
            F.when(F.col("field") == DELAY, seconds),
            F.when((F.col("field") == DELAY) & seconds.isNotNull(), F.col("line_no")),
        ).alias("crawl_delay"),
    )


def rule_regex(pattern: Column) -> Column:
    """A robots pattern with ``*`` or ``$`` as a regular expression."""
    escaped = F.regexp_replace(pattern, r"[.+?^{}()|\[\]\\]", r"\\$0")
    starred = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(starred, F.lit("$"), F.lit("\\z")))


def compile_rule(pattern: Column) -> Column:
    """``struct<prefix, regex, size>``; plain patterns have no regex, empty ones are null."""
    wild = F.when(pattern.rlike("[*$]"), rule_regex(pattern))
    prefix = F.regexp_extract(pattern, "^[^*$]*", 0)
    return F.when(pattern != "", fields(prefix=prefix, regex=wild, size=F.length(pattern)))


# One entry per literal start of a rule, in byte order.  up: the longest other start this one begins with;
# depth: how many there are, with itself; allow, disallow: the longest plain rules among them;
# wild: the nearest of them with patterns, hops: how many have some, wild_up: the next one after this.
INDEX_DDL = (
    "array<struct<prefix:string,up:int,depth:int,allow:int,disallow:int,wild:int,hops:int,wild_up:int,"
    "rules:array<struct<regex:string,size:int,allow:boolean>>>>"
)


def rule_index(allow: list[dict], disallow: list[dict]) -> list[dict]:
    """The sorted index of one origin's compiled rules."""
    starts: dict[str, dict] = {}
    for rules, kind in ((allow, "allow"), (disallow, "disallow")):
        for rule in rules:
            entry = starts.setdefault(rule["prefix"], {"prefix": rule["prefix"], "allow": -1, "disallow": -1, "rules": []})
            if rule["regex"] is None:
                entry[kind] = max(entry[kind], rule["size"])
            else:
                entry["rules"].append({"regex": rule["regex"], "size": rule["size"], "allow": kind == "allow"})
    index, open_ = [starts[p] for p in sorted(starts)], []
    for i, entry in enumerate(index):
        while open_ and not entry["prefix"].startswith(index[open_[-1]]["prefix"]):
            open_.pop()
        above = index[open_[-1]] if open_ else {"allow": -1, "disallow": -1, "wild": -1, "hops": 0}
        own = bool(entry["rules"])
        entry |= {
            "up": open_[-1] if open_ else -1,
            "depth": len(open_) + 1,
            "allow": max(entry["allow"], above["allow"]),
            "disallow": max(entry["disallow"], above["disallow"]),
            "wild": i if own else above["wild"],
            "hops": above["hops"] + own,
            "wild_up": above["wild"],
        }
        open_.append(i)
    return index


def indexed(rulesets: DataFrame) -> DataFrame:
    """``origin, crawl_delay, index``: the rules of every origin, sorted for :func:`is_allowed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            indexes = [rule_index(a or [], d or []) for a, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            rule = pa.struct([("regex", pa.string()), ("size", pa.int32()), ("allow", pa.bool_())])
            numbers = ("up", "depth", "allow", "disallow", "wild", "hops", "wild_up")
            entry = pa.struct([("prefix", pa.string()), *[(n, pa.int32()) for n in numbers], ("rules", pa.list_(rule))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(indexes, pa.list_(entry))], names=["origin", "crawl_delay", "index"]
            )

    narrow = rulesets.select("origin", "crawl_delay", "allow", "disallow")
    return narrow.mapInArrow(run, f"origin string, crawl_delay double, index {INDEX_DDL}")


def is_allowed(index: Column, path: Column) -> Column:
    """Longest match decides, ties go to allow, no rules means allowed.

    The last start that is not after the path is found by binary search.  Every rule's start
    that the path begins with is one of those it begins with itself, so a short way up from
    it gives the longest plain rules; only patterns on that way are tried.
    """
    entry = "get(_a.index, {})".format
    between = sql_fields(lo="0", hi="size(_a.index)")
    middle = entry("(_s.lo + _s.hi) div 2")
    halved = f"if({middle}.prefix <= _a.path, {sql_fields(lo='int((_s.lo + _s.hi) div 2) + 1', hi='_s.hi')}, {sql_fields(lo='_s.lo', hi='int((_s.lo + _s.hi) div 2)')})"
    steps = "sequence(1, int(ceil(log2(size(_a.index) + 1))) + 1)"
    last = f"aggregate({steps}, {between}, (_s, _i) -> if(_s.lo < _s.hi, {halved}, _s), _s -> _s.lo - 1)"
    climbed = f"aggregate(sequence(1, {entry('_p')}.depth), _p, (_q, _i) -> if(_q < 0 or startswith(_a.path, {entry('_q')}.prefix), _q, {entry('_q')}.up))"

    def best(allow: str, so_far: str) -> str:
        matching = f"filter({entry('_w.at')}.rules, _r -> {allow} _r.allow and rlike(_a.path, _r.regex))"
        return f"greatest({so_far}, coalesce(array_max(transform({matching}, _r -> _r.size)), -1))"

    start = sql_fields(at=f"{entry('_e')}.wild", allow=f"{entry('_e')}.allow", disallow=f"{entry('_e')}.disallow")
    onward = sql_fields(at=f"{entry('_w.at')}.wild_up", allow=best("", "_w.allow"), disallow=best("not", "_w.disallow"))
    verdict = "_w -> _w.disallow < 0 or _w.allow >= _w.disallow"
    hops = f"if({entry('_e')}.hops > 0, sequence(1, {entry('_e')}.hops), cast(array() as array<int>))"
    judged = f"if(_e < 0, true, aggregate({hops}, {start}, (_w, _i) -> {onward}, {verdict}))"
    found = sql_let("_p", last, sql_let("_e", f"if(_p < 0, -1, {climbed})", judged))
    return F.coalesce(sql_call(f"if(size(_a.index) > 0, {found}, true)", index=index, path=path), F.lit(True))


def admit(wanted: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Add ``origin``, ``allowed`` and ``crawl_delay`` to a table with ``url``.

    Rules are held against the normalised URL.  A URL that has no such form gets no
    origin and is not allowed.  Origins without a robots file allow everything.

    Both sides go through an exchange of their own, by origin, so that the skew join
    can split a busy origin; the rule side alone would come without one.
    """
    located = wanted.withColumn("_href", urls.normal(F.col("url"))).withColumn("origin", urls.origin(F.col("_href")))
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = indexed(rulesets).repartition(parts, F.xxhash64("origin"))
    judged = is_allowed(F.col("index"), urls.path_query(F.col("_href")))
    return (
        located.join(rules, "origin", "left")
        .withColumn("allowed", F.col("origin").isNotNull() & judged)
        .drop("index", "_href")
    )
