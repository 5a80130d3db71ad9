import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from fixtures import SHED_1, SHED_2, SHED_SPEC, SHED_URLS as URLS
from pageloom import Site, parse_spec
from pageloom.operators.hits import request_hits
from pageloom.sources import cache, pages
from pageloom.sources.sinks import write_result
from pageloom.sources.store import SnapshotStore
from pageloom.streaming import jobs


def page_rows(spark):
    return spark.createDataFrame(list(zip(URLS, [SHED_1, SHED_2])), "url string, html string")


def test_cache_folder(spark, tmp_path):
    def put(url, text):
        (tmp_path / (hashlib.sha256(url.encode()).hexdigest() + ".json")).write_text(text)

    put(URLS[0], json.dumps({"body": SHED_1, "finalUrl": URLS[0] + "x", "storedAt": 1700000000000}))
    put(URLS[1], '{"body": "broken')
    known = spark.createDataFrame([(u,) for u in [*URLS, "https://other.example/"]], "url string")
    (row,) = cache.read_cache_folder(spark, str(tmp_path), known).collect()
    assert (row.url, row.final_url, row.body) == (URLS[0], URLS[0] + "x", SHED_1)
    assert row.stored_at.timestamp() == 1700000000


def test_cache_folder_opens_known_files_only(spark, tmp_path):
    entry = lambda body: json.dumps({"body": body, "storedAt": 5})
    rows = spark.createDataFrame([("a", entry("1")), ("b", entry("2")), ("c", "{}")], "url string, entry string")
    folder = cache.write_cache_folder(rows, str(tmp_path / "f"))
    found = cache.read_cache_folder(spark, folder, spark.createDataFrame([("a",), ("c",), ("d",), (None,), ("a",)], "url string"))
    assert [(r.url, r.final_url, r.body) for r in found.collect()] == [("a", "a", "1")]
    opened = {f.rsplit("/", 1)[-1] for f in found.inputFiles()}
    assert opened == {hashlib.sha256(u.encode()).hexdigest() + ".json" for u in "ac"}
    assert cache.read_cache_folder(spark, folder, spark.createDataFrame([("x",)], "url string")).count() == 0


def test_shared_cache_folder(spark, tmp_path):
    """Tasks write one file per URL and nothing else, and a URL that repeats in several of them loses no entry."""
    entry = lambda body: json.dumps({"body": body, "storedAt": 5})
    rows = [(f"u{i % 150}", entry(f"{i}\n\u00fc")) for i in range(160)] + [(None, entry("x")), ("void", None)]
    given = spark.createDataFrame(rows, "url string, entry string").repartition(7)
    folder = cache.write_cache_folder(given, f"file://{tmp_path}/f")
    name = lambda url: hashlib.sha256(url.encode()).hexdigest() + ".json"
    assert os.listdir(tmp_path / "f") == ["entries"] and folder == f"file://{tmp_path}/f/entries"
    assert set(os.listdir(tmp_path / "f" / "entries")) == {name(u) for u, _ in rows if u}
    known = spark.createDataFrame([(u,) for u, _ in rows if u != "u9"] + [("other",)], "url string")
    found = cache.read_cache_folder(spark, folder, known)
    assert found.inputFiles() == [] and "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((u, u, json.loads(e)["body"]) for u, e in rows if u not in (None, "void", "u9"))
    assert sorted((r.url, r.final_url, r.body) for r in found.collect()) == want
    with pytest.raises(FileExistsError):
        cache.write_cache_folder(given, f"file://{tmp_path}/f")
    empty = cache.write_cache_folder(given.limit(0), f"file://{tmp_path}/g")
    assert cache.read_cache_folder(spark, empty, known).count() == 0


def test_odd_cache_files_read_alike(spark, tmp_path):
    """A shared folder's files mean what they mean to Spark's reader."""
    odd = {
        "bom": b'\xef\xbb\xbf{"body": "b"}', "cut": b'{"body": "cut', "latin": b'{"body": "\xe4"}', "blank": b"\n \r\n",
        "lines": b'{"body": "1"}\r\n\r{"body": "2", "finalUrl": "z"}\nbroken', "list": b' [{"body": "1"}, {"body": "2"}]',
        "types": b'{"body": 7, "storedAt": "late", "more": []}', "null": b"null", "none": b"", "bare": b'{"finalUrl": "y"}',
        "deep": b'{"body": "d", "storedAt": 1700000000000}', "hidden": b'{"body": "h"}', "temporary": b'{"body": "t"}',
    }
    for url, content in odd.items():
        at = tmp_path / {"deep": "a/b", "hidden": ".h", "temporary": "_t"}.get(url, "")
        at.mkdir(parents=True, exist_ok=True)
        (at / (hashlib.sha256(url.encode()).hexdigest() + ".json")).write_bytes(content)
    known = spark.createDataFrame([(u,) for u in odd], "url string")
    by_spark, by_tasks = (
        sorted(map(tuple, cache.read_cache_folder(spark, path, known).collect()), key=str) for path in (str(tmp_path), f"file:{tmp_path}")
    )
    assert by_tasks == by_spark
    assert [(r[0], r[2]) for r in by_tasks] == [
        ("bom", "b"), ("deep", "d"), ("lines", "1"), ("lines", "2"), ("list", "1"), ("list", "2"), ("types", "7")
    ]


def test_snapshot_table(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("a", "old", 1), ("b", "b", 5)], "url string, body string, s bigint")
    frame = lambda df: df.select("url", F.lit(None).cast("string").alias("final_url"), "body", F.timestamp_seconds("s").alias("stored_at"))
    cache.write_snapshots(frame(rows), path)
    cache.write_snapshots(frame(spark.createDataFrame([("a", "new", 9)], rows.schema)), path)
    assert {r.url: r.body for r in cache.read_snapshots(spark, path).collect()} == {"a": "new", "b": "b"}
    cache.compact_snapshots(spark, path, str(tmp_path / "c"))
    stored = cache.read_snapshots(spark, str(tmp_path / "c"))
    assert {r.url: r.html for r in cache.as_pages(stored).collect()} == {"a": "new", "b": "b"}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_html_files_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.html").write_text(SHED_1)
    found = pages.read_html_files(spark, str(tmp_path / "in"))
    rows = Site(parse_spec(SHED_SPEC), found).over_pages("tools").collect()
    assert len(rows) == 4 and rows[0].url.endswith("s.html")
    result = Site(parse_spec(SHED_SPEC), page_rows(spark)).resource("tools")
    write_result(result, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out" / "data")).count() == 7
    assert spark.read.json(str(tmp_path / "out" / "meta")).first().pages == 2


def test_pages_as_files(spark, tmp_path):
    """Each row is one file, written by the tasks or by Spark, and few tasks read many small files."""
    texts = [f"<p>{i % 50} ü</p>" for i in range(200)] + [None, "", "a\r\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "html string").repartition(3)
    for path in (f"file://{tmp_path}/by-tasks", str(tmp_path / "by-spark")):
        folders = pages.write_html_files(rows, path)
        assert len(folders) == (3 if path.startswith("file:") else 1)
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        try:
            found = pages.read_html_files(spark, folders)
            assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
            got = found.collect()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(r.html for r in got) == sorted((t or "") + "\n" for t in texts)
        assert len({r.url for r in got}) == len(texts)
    none = pages.write_html_files(rows.where("false"), f"file://{tmp_path}/none")
    assert pages.read_html_files(spark, none).where("trim(html) <> ''").count() == 0


def test_read_pages_spreads_small_files(spark, tmp_path):
    page_rows(spark).coalesce(1).write.parquet(str(tmp_path / "p"))
    read = pages.read_pages(spark, str(tmp_path / "p"))
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [r.final_url for r in read.orderBy("url").collect()] == URLS
    assert pages.spread(read).rdd.getNumPartitions() == read.rdd.getNumPartitions()


def test_stream_extraction_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    page_rows(spark).repartition(2).write.parquet(source)
    stream = jobs.stream_pages(spark, source, "url string, html string", 1)
    spec = parse_spec(SHED_SPEC)
    jobs.start_extraction(Site(spec, stream), "tools", out, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    expected = Site(spec, page_rows(spark)).over_pages("tools")
    key = lambda df: sorted((r.url, r._row_no, r.label, tuple(r.uses)) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(expected)


def test_stream_snapshots(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    ddl = "url string, final_url string, body string, stored_at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "url string, body string, s bigint").select(
        "url", F.lit(None).cast("string").alias("final_url"), "body", F.timestamp_seconds("s").alias("stored_at")
    ).coalesce(1)
    make([("a", "a1", 1), ("a", "a3", 3), ("b", "b1", 1)]).write.mode("append").parquet(str(source))
    make([("a", "a2", 2), ("b", "b2", 2)]).write.mode("append").parquet(str(source))
    stream = jobs.stream_pages(spark, str(source), ddl, 1)
    jobs.start_snapshots(stream, out, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert {r.url: r.body for r in SnapshotStore(spark, out).read().collect()} == {"a": "a3", "b": "b2"}


def test_snapshot_store(spark, tmp_path):
    path = str(tmp_path / "s")
    store = SnapshotStore(spark, path, merge_every=3, buckets=2)

    def put(rows, generation=None):
        frame = spark.createDataFrame(rows, "url string, body string, s bigint")
        copies = frame.select("url", F.lit(None).cast("string").alias("final_url"), "body", F.timestamp_seconds("s").alias("stored_at"))
        store.append(copies.coalesce(1), generation)

    def state(**options):
        return {r.url: (r.body, r.stored_at and int(r.stored_at.timestamp())) for r in store.read(**options).collect()}

    assert state() == {}
    put([(f"u{i}", f"first {i}", 10) for i in range(20)] + [(None, "no url", 1)])
    put([("u1", "older", 5), ("u2", "newer", 11), ("u3", None, None), ("v", "v", None)])
    expected = {f"u{i}": (f"first {i}", 10) for i in range(20)} | {"u2": ("newer", 11), "v": ("v", None), None: ("no url", 1)}
    assert state() == expected
    # the third generation merges; most of the first file no longer counts and what does moves
    put([(f"u{i}", f"third {i}", 12) for i in range(4, 20)])
    expected |= {f"u{i}": (f"third {i}", 12) for i in range(4, 20)}
    assert state() == expected and store._last() == (2, 2)
    folders = {r.folder for r in store.index().select("folder").distinct().collect()}
    assert folders == {"1", "2", "2-merged"} and store.index().count() == 22
    put([], None)
    put([("u1", "fifth", 13), ("u1", "fifth", 13), ("w", "w", 1)])
    expected |= {"u1": ("fifth", 13), "w": ("w", 1)}
    assert state() == expected
    # a generation that is repeated replaces itself
    put([("u1", "fifth again", 13), ("w", "w", 1)], 4)
    expected["u1"] = ("fifth again", 13)
    assert state() == expected
    asked = spark.createDataFrame([("u1",), ("v",), ("none",), ("u1",)], "url string")
    assert state(wanted=asked) == {"u1": ("fifth again", 13), "v": ("v", None)}
    assert {r.url: r.stored_at for r in store.read(["url", "stored_at"], asked).collect()}.keys() == {"u1", "v"}

    # no body is near what decides, and files without a copy that counts are not read
    plan = store.winners(store.index())._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "final_url" not in plan
    read = store.read(wanted=asked)
    names = {f.rsplit("/", 1)[-1] for f in read.inputFiles()}
    counted = store.winners(store.index(asked)).select("file").distinct().collect()
    assert {n for n in names if n in {r.file for r in store.index().select("file").collect()}} == {r.file for r in counted}
    # bodies meet the index on (file, row) only, and no aggregate
    lines = read._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("body" in line for line in lines if "Aggregate" in line or "hashpartitioning(url" in line)


@pytest.mark.parametrize("hot_rows", [1000, 4])
def test_stream_hits_equal_batch(spark, tmp_path, hot_rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"u{i % 3}", 1_700_000_000_000 + i * 700) for i in range(60)]
    table = spark.createDataFrame(rows, "request_id bigint, url string, ms bigint").select(
        "request_id", "url", F.timestamp_millis("ms").alias("ts")
    )
    for part in range(3):
        table.where(f"request_id between {part * 20} and {part * 20 + 19}").coalesce(1).write.mode("append").parquet(source)
    # two hours late, in a batch of its own: kept, and within the period of a known fetch
    late = table.where("request_id = 0").select(F.lit(99).cast("bigint").alias("request_id"), "url", (F.col("ts") - F.expr("interval 2 hours")).alias("ts"))
    late.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.start_hits(stream, 5000, out, str(tmp_path / "ck"), hot_rows=hot_rows, availableNow=True).awaitTermination()
    numeric = table.select("request_id", "url", F.unix_millis("ts").alias("ts"))
    expected = {r.request_id: r.hit for r in request_hits(numeric, 5000).collect()}
    assert {r.request_id: r.hit for r in spark.read.parquet(out + "/hits").collect()} == expected | {99: True}


def test_hits_without_a_time(spark):
    rows = [("a", 1, None), ("a", 2, 100), ("a", 3, 150), ("a", None, None), (None, 5, 7), (None, 6, 9), ("b", 7, None), ("c", (1 << 53) + 1, (1 << 53) + 1)]
    requests = spark.createDataFrame(rows, "url string, request_id bigint, ts bigint")
    expected = {1: False, 2: False, 3: True, None: False, 5: False, 6: True, 7: False, (1 << 53) + 1: False}
    for hot in (1000, 1):
        keyed = requests if hot == 1000 else requests.where("url is not null")
        got = request_hits(keyed, 100, hot_rows=hot).collect()
        assert {r.request_id: r.hit for r in got} == {r.request_id: expected[r.request_id] for r in keyed.collect()}
        # whole numbers stay exact beside nulls
        assert sorted((r.request_id, r.ts) for r in got if r.url == "c") == [((1 << 53) + 1, (1 << 53) + 1)]


def test_stream_hits_state_is_written_by_change(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(part * 1000 + i, f"u{i}" if part == 0 else f"u{i * 7 % 900}", 1_700_000_000_000 + part * 10_000) for part in range(7) for i in range(900 if part == 0 else 5)]
    table = spark.createDataFrame(rows, "request_id bigint, url string, ms bigint")
    for part in range(7):
        own = table.where(f"request_id between {part * 1000} and {part * 1000 + 999}")
        own.select("request_id", "url", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
    stream = jobs.stream_pages(spark, str(source), "request_id bigint, url string, ts timestamp", 1)
    jobs.start_hits(stream, 5000, str(out), str(tmp_path / "ck"), merge_every=3, buckets=2, availableNow=True).awaitTermination()
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    deltas = [spark.read.parquet(str(out / "state" / "delta" / str(n))).count() for n in range(7)]
    assert deltas == [900, 5, 5, 5, 5, 5, 5]
    assert all(size(out / "state" / "delta" / str(n)) * 3 < size(out / "state" / "delta" / "0") for n in range(1, 7))
    assert sorted(p.name for p in (out / "state" / "base").iterdir()) == ["2", "5"]
    assert spark.read.parquet(str(out / "state" / "base" / "5")).count() == 900
    numeric = table.select("request_id", "url", F.col("ms").alias("ts"))
    expected = {r.request_id: r.hit for r in request_hits(numeric, 5000).collect()}
    assert {r.request_id: r.hit for r in spark.read.parquet(str(out / "hits")).collect()} == expected
