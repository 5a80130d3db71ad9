"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe,
    decontam,
    divergence,
    groupjoin,
    katz,
    langid,
    maintext,
    mixing,
    quality,
    repair,
    shards,
    toxicity,
    warc,
)
from pageloom.llm.common import crc_mod, stored, table
from pageloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))
# features, ratios and verdict of each row of a relation with doc_id and text
QUALITY_SQL = f"""
words as (select doc_id, coalesce(text, '') as body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from source_docs),
windows as (select doc_id, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as w
  from (select doc_id, words, unnest(range(0, greatest(len(words) - 2, 0))) as i from words)),
twins as (select doc_id, i from (select *, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twins, (values (0), (1), (2)) as v(k) group by doc_id),
counted as (select words.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
    len(list_filter(words, lambda w: lower(w) in ({_STOPS})))::bigint as n_stop_words,
    coalesce(covered.n, 0)::bigint as n_repeat_words
  from words left join covered on words.doc_id = covered.doc_id),
judged as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
    (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
    (word_chars / greatest(n_words, 1) between 2.0 and 14.0 and n_symbols / greatest(word_chars, 1) <= 0.05
      and n_stop_words / greatest(n_words, 1) >= 0.02 and n_dup_lines / greatest(n_lines, 1) <= 0.5) as ratios_hold
  from counted)
"""


@query(
    f"""with source_docs as (select doc_id, text from documents), {QUALITY_SQL}
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
      not base_failed and ratios_hold as kept from judged"""
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the threshold table for every document."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"
    )


def _hash_sql(salt: str) -> str:
    return f"((('0x' || substr(md5(key || ':' || {salt}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"


def _best_sql(n: int) -> str:
    return f"list_reduce(list_transform(range(0, {n}), lambda s: {{'u': {_hash_sql('s::varchar')}, 's': s}}), lambda a, b: case when b.u > a.u then b else a end).s::int"


@query(
    f"""with bits as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as t
      from range(0, 256) as r(i)),
    keyed as (select doc_id, coalesce(doc_id::varchar, '') as key, encode(coalesce(text, '')) as body from documents),
    placed as (select doc_id, (octet_length(body) + 8)::bigint as size,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(body), '..'), lambda p: ('0x' || p)::bigint)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as text_crc32,
        {_best_sql(24)} as shard, {_best_sql(25)} as grown_shard,
        floor({_hash_sql("'slot'")} * {shards.PARTS})::int as part
      from keyed, bits)
    select doc_id, size, text_crc32, 'key' as law, shard,
      row_number() over (partition by shard order by part, doc_id, text_crc32, size) - 1 as slot, grown_shard
    from placed"""
)
def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by their id, and where a 25th shard would leave them."""
    return shards.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)


def byte_bpe(spark: SparkSession) -> bpe.ByteBPE:
    import public_tokenizers

    return bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    codec = byte_bpe(spark)
    return codec.digests(codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, carry=("held_out",))


@query()
def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, scorer, carry=("doc_id", "held_out"))


@query()
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((part{k} >> {35 - 5 * j}) & 31)::int, 1)" for k in range(4) for j in range(8)
)
_PARTS = ", ".join(f"('0x' || substr(digest, {1 + 10 * k}, 10))::bigint as part{k}" for k in range(4))


@query(
    f"""with paid as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
        sha1(coalesce(html, '')) as digest, max(page_id) over (partition by coalesce(html, '')) as last from pages)
    select page_id, payload_bytes, {_BASE32} as payload_digest,
      case when page_id < last then 'revisit' else 'response' end as record_type,
      case when page_id < last then last end as refers_to
    from (select *, {_PARTS} from paid)"""
)
def op1_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC files and read back."""
    records = warc.arc_records(warc.arc_archives(table(spark, sf_dir, "pages")))
    path = scratch_path(spark, "warc")
    warc.convert(records, path)
    # read back once; only revisits look for the page they refer to
    rows = stored(warc.read_archives(spark, path).drop("payload", "uri"), "archived")
    own = rows.where("refers_to_id is null")
    responses = own.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    repeats = rows.where("refers_to_id is not null").join(responses, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(repeats.select(*columns))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.fit(pages))


@query()
def op8_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document under Jaccard links of 0.8."""
    return groupjoin.components(table(spark, sf_dir, "documents"))


@query()
def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz and add-a-tenth scores of every document, learned from those outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))
    return katz.evaluate(docs, ~F.col("held_out"), carry=("held_out",))


@query()
def op11_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _edit(state: str, letter: str, price: str, role: str | None = None, text: str = "''") -> str:
    """SQL of a way on from a state of the role pattern: its cost, audit and output so far."""
    line = f"{state}.o" if role is None else f"{state}.o || {chr(39)*2 if state == 's0' else 'chr(10)'} || {role} || ':' || {text}"
    return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', 'o': {line}}}"


def _repair_sql() -> str:
    """All edits of all rows over the states start, after s, after u, after a; each keeps its least (cost, audit)."""
    never, before_u = "1000000000", ("s0", "s1", "s3")
    kept = lambda initial: f"case when not must_go and left(role, 1) = '{initial}' then cut * 5 else {never} end"
    reroled = f"case when not must_go then 1 + cut * 5 else {never} end"
    gone = lambda state: _edit(state, "D", "2")
    ways = {
        "s0": [gone("s0")],
        "s1": [gone("s1"), _edit("s0", "K", kept("s"), "role", "text")],
        "s2": [gone("s2")]
        + [_edit(s, "K", kept("u"), "role", "text") for s in before_u]
        + [_edit(s, "R", reroled, "'user'", "text") for s in before_u],
        "s3": [gone("s3"), _edit("s2", "K", kept("a"), "role", "text"), _edit("s2", "R", reroled, "'assistant'", "text")],
    }
    least = lambda found: f"list_sort([{', '.join(found)}])[1]"
    put_u = least(["s2"] + [_edit(s, "I", "5", "'user'") for s in before_u])
    put_a = least(["s3", _edit("s2", "I", "5", "'assistant'")])
    start = {"s0": f"{{'c': 0, 'a': '', 'o': ''}}", **{s: f"{{'c': {never}, 'a': '', 'o': ''}}" for s in ("s1", "s2", "s3")}}
    return f"""
    with recursive bits as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as t from range(0, 256) as r(i)),
    marked as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))), '..'), lambda p: ('0x' || p)::bigint)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as fault from conversations, bits),
    convs as (select conv_id, row_number() over () as conv from (select distinct conv_id from conversations)),
    damaged as (select conv, turn, case when fault = 4 then 'user' else role end as role,
        case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from marked join convs on convs.conv_id is not distinct from marked.conv_id
      join (values (0), (1)) as v(k) on k = 0 or fault = 3 where fault <> 0),
    numbered as (select *, row_number() over (partition by conv order by turn nulls first, role, text) as rn from damaged),
    ordered as (select *, row_number() over (partition by conv, role, text order by rn) > 1 as twin,
        not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank from numbered),
    judged as (select *, blank or twin as must_go,
        (not blank and not twin and not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z'))::int as cut,
        lag(left(role, 1)) over (partition by conv order by rn) || left(role, 1) as step from ordered),
    opened as (select conv, 0::bigint as rn, {", ".join(f"{sql} as {s}" for s, sql in start.items())} from convs),
    walk as (
      select conv, rn, s0, s1, s2, {put_a} as s3 from (select * replace ({put_u} as s2) from opened)
      union all
      select conv, rn, s0, s1, s2, {put_a} as s3 from (select * replace ({put_u} as s2) from (
        select walk.conv, judged.rn, {", ".join(f"{least(found)} as {s}" for s, found in ways.items())}
        from walk join judged on judged.conv = walk.conv and judged.rn = walk.rn + 1))),
    ended as (select conv, {least(["s0", "s3"])} as best from walk qualify row_number() over (partition by conv order by rn desc) = 1),
    counted as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
        count(*) filter (blank)::bigint as blank, count(*) filter (twin and not blank)::bigint as duplicate,
        sum(cut)::bigint as truncated, count(*) filter (step is not null and step not in ('su', 'ua', 'au'))::bigint as illegal
      from judged group by conv)
    select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
      coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit,
      sha256(best.o) as repaired_sha256
    from convs join ended using (conv) left join counted using (conv)"""


@query(_repair_sql())
def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), F.col("gone"))


@query(
    r"""with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words, row_number() over () as d from documents),
    said as (select lang, source, d, unnest(words) as term from docs),
    counts as (select lang, source, term, count(*) as n from said group by all),
    kept as (select lang, term from said group by all having count(distinct d) >= 10),
    langs as (select lang, count(*) as v from kept group by lang),
    groups as (select distinct lang, source from docs),
    used as (select c.* from counts c join kept using (lang, term)),
    totals as (select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(sum(u.n), 0)::bigint as total
      from groups g left join langs l using (lang) left join used u using (lang, source) group by all),
    whole as (select lang, sum(n)::bigint as total from used group by lang),
    whole_terms as (select lang, term, sum(n)::bigint as n from used group by all),
    p as (select t.lang, t.source, k.term, coalesce(u.n, 0) as n,
        1 + (1000000000 * (coalesce(u.n, 0) + 2)) // (t.total + 2 * t.v) as p
      from totals t join kept k using (lang) left join used u on u.lang = t.lang and u.source = t.source and u.term = k.term),
    q as (select w.lang, w.term, 1 + (1000000000 * (w.n + 2)) // (h.total + 2 * l.v) as q
      from whole_terms w join whole h using (lang) join langs l using (lang)),
    sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    marks as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
      from p join q using (lang, term) where n > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank
      from (select * from pairs union all select * from marks))
    select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10"""
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that mark each source."""
    return divergence.audit(table(spark, sf_dir, "documents"))
