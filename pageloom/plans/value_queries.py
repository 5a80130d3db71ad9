"""Value transforms, URL helpers and name helpers over whole columns of the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import names, text, urls
from pageloom.operators.extract import extract, trees_for
from pageloom.plans.extraction_queries import NAV_SQL, one_resource
from pageloom.plans.registry import query
from pageloom.plans.tables import documents, longs, pages, table

# The same character class as text.WHITESPACE, in the oracle's notation.
SQL_SPACE = (
    r"[\t\n\f\r\v \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
PADDED_SQL = r"concat('  ', chr(160), chr(9), text, chr(10), chr(8195), ' ')"


def number_sql(column: str) -> str:
    packed = f"regexp_replace({column}, '[,]|{SQL_SPACE}', '', 'g')"
    return f"regexp_extract({packed}, '-?[0-9]+(?:[.][0-9]+)?')"


def padded() -> Column:
    """Document text between whitespace that is not all ASCII."""
    return F.concat(F.lit("  \u00a0\t"), F.col("text"), F.lit("\n\u2003 "))


@query(
    f"""
    select doc_id, md5(trim(regexp_replace({PADDED_SQL}, '{SQL_SPACE}+', ' ', 'g'))) as collapsed,
           md5(regexp_replace(regexp_replace({PADDED_SQL}, '^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '')) as trimmed
    from documents
    """
)
def transform_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(
        "doc_id",
        F.md5(text.collapse(padded())).alias("collapsed"),
        F.md5(text.apply_built_in("trim", padded(), "string", F.lit(""))).alias("trimmed"),
    )


@query(
    """
    select conv_id, turn, md5(lower(text)) as lowered, md5(upper(replace(text, 'ß', 'SS'))) as uppered
    from conversations
    """
)
def transform_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.md5(text.apply_built_in("lower", F.col("text"), "string", F.lit(""))).alias("lowered"),
        F.md5(text.apply_built_in("upper", F.col("text"), "string", F.lit(""))).alias("uppered"),
    )


@query(
    f"""
    select c_custkey, try_cast(nullif({number_sql('t')}, '') as double) as f,
           trunc(try_cast(nullif({number_sql('t')}, '') as double))::bigint as i
    from (select c_custkey, case when c_custkey % 5 = 0 then c_mktsegment else
            '£ ' || cast(cast(c_acctbal as decimal(12,2)) as varchar) || ' of 1,' || c_nationkey end as t
          from customer)
    """
)
def transform_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(
        F.concat(
            F.lit("£ "),
            F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
            F.lit(" of 1,"),
            F.col("c_nationkey"),
        )
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.apply_built_in("float", value, "string", F.lit("")).alias("f"),
        text.apply_built_in("int", value, "string", F.lit("")).alias("i"),
    )


@query(f"select doc_id, {number_sql('text')} as first from documents")
def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of every whole document."""
    return documents(spark, sf_dir).select("doc_id", text.first_number(F.col("text")).alias("first"))


@query(
    """
    select event_id, coalesce(w in ('true', 'yes', '1', 'on'), false) as flag
    from (select event_id, lower(trim(['Yes ', 'on', '1', 'TRUE', 'no', '0', '', 'yess', 'o n', event_type][event_id % 10 + 1])) as w
          from events)
    """
)
def transform_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [F.lit(w) for w in ("Yes ", "on", "1", "TRUE", "no", "0", "", "yess", "o n")]
    word = F.get(F.array(*words, F.col("event_type")), (F.col("event_id") % 10).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.apply_built_in("boolean", word, "string", F.lit("")).alias("flag")
    )


@query(
    """
    select p_partkey, regexp_replace(cast(p_retailprice as varchar), '\\.0$', '') as shown,
           cast(trunc(p_retailprice)::bigint as varchar) as whole
    from part
    """
)
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text step follows print without a trailing '.0'."""
    raw = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    number = text.apply_built_in("float", raw, "string", F.lit(""))
    whole = text.apply_built_in("int", raw, "string", F.lit(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.apply_built_in("upper", number, "double", F.lit("")).alias("shown"),
        text.apply_built_in("trim", whole, "bigint", F.lit("")).alias("whole"),
    )


@query(
    f"""
    with {NAV_SQL}
    select page_id, row_no,
           regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as link,
           regexp_extract(url, '^[^?#]+') || case when regexp_extract(url, '^[^?#]+') like '%/' then '' else '' end as page,
           regexp_replace(regexp_extract(url, '^[^?#]+'), '[^/]*$', '') || 'up' as sibling,
           regexp_extract(url, '^[a-z]+://[^/?#]+') || '/up?a=b' as upward,
           regexp_extract(url, '^[^#]+') || '#end' as anchor
    from nav
    """
)
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = one_resource({"link": {"selector": "a", "attr": "href", "transform": "url"}}, "nav li")
    trees = trees_for(pages(spark, sf_dir), [resource], ["page_id", "url", "final_url"])
    rows = extract(trees, resource, ["page_id", "url"])
    base = F.col("url")
    return longs(
        rows.select(
            "page_id",
            F.col("_row_no").alias("row_no"),
            "link",
            urls.resolve(F.regexp_extract("url", "[^/?#]*(?=([?#]|$))", 0), base).alias("page"),
            urls.resolve(F.lit("./x/../up"), base).alias("sibling"),
            urls.resolve(F.lit("/../up?a=b"), base).alias("upward"),
            urls.resolve(F.lit("#end"), base).alias("anchor"),
        )
    )


@query(
    """
    select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') as origin,
           regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path_query,
           regexp_extract(url, '//([^/?#:]+)', 1) as host,
           split_part(regexp_replace(regexp_extract(url, '//([^/?#:]+)', 1), '^www\\.', ''), '.', 1) as site,
           sha256(url) as cache_key
    from pages
    """
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.origin(url).alias("origin"),
        urls.path_query(url).alias("path_query"),
        urls.host(url).alias("host"),
        names.site_name(urls.host(url)).alias("site"),
        names.cache_key(url).alias("cache_key"),
    )


@query(
    """
    select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page,
           case when url like '%?page=%' then regexp_replace(url, 'page=[^&#]*', 'page=' || page_id)
                when url like '%?%' then url || '&page=' || page_id
                when url like '%#%' then replace(url, '#', '?page=' || page_id || '#')
                else url || '?page=' || page_id end as changed
    from pages
    """
)
def query_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.query_param(url, "page").alias("page"),
        urls.with_query_param(url, "page", F.col("page_id").cast("string")).alias("changed"),
    )


@query(
    """
    select doc_id, md5(replace(replace(replace(replace(replace(url_encode(text),
        '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')) as encoded
    from documents
    """
)
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encodeURIComponent over whole documents."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(urls.encode_component(F.col("text"))).alias("encoded"))


@query(
    """
    select c_custkey, lower(split_part(split_part(split_part(ua, ' ', 1), '/', 1), '(', 1)) as token
    from (select c_custkey, case c_custkey % 4 when 0 then c_mktsegment || '-Bot/1.0 (+https://x)' when 1 then c_name || ' (x)'
            when 2 then c_mktsegment || '(y' else c_name end as ua from customer)
    """
)
def agent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    agent = (
        F.when(kind == 0, F.concat("c_mktsegment", F.lit("-Bot/1.0 (+https://x)")))
        .when(kind == 1, F.concat("c_name", F.lit(" (x)")))
        .when(kind == 2, F.concat("c_mktsegment", F.lit("(y")))
        .otherwise(F.col("c_name"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", names.agent_token(agent).alias("token"))


@query(
    r"""
    select p_partkey, ok[1] as first_class, 'div' || array_to_string(list_transform(ok[1:2], lambda c: '.' || c), '') as signature
    from (select p_partkey, list_filter(regexp_split_to_array('9x  ' || p_brand || ' ' || p_name || ' ' || p_type, ' +'),
                 lambda c: regexp_full_match(c, '[a-zA-Z][a-zA-Z0-9_-]*')) as ok from part)
    """
)
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.concat_ws(" ", F.lit("9x "), "p_brand", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        names.first_class(css).alias("first_class"),
        names.signature(F.lit("div"), names.split_classes(css)).alias("signature"),
    )
