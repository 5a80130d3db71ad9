"""URL expressions: resolution, percent-encoding, origins, query parameters, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.cols import sql_call, sql_fields, sql_let

# Schemes with an authority, and the port each one implies.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
SPECIAL = "(?i)^(http|https|ftp|wss|ws):"

# Characters the URL standard percent-encodes, per part.
UNSAFE_PATH = r"[^!$-;=@-_a-z|~]"
UNSAFE_QUERY = r"[^!$-&(-;=?-~]"
UNSAFE_FRAGMENT = r"[^!#-;=?-_a-~]"
UNSAFE_OPAQUE = r"[^ -~]"
FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^`{|}\x7f]"

URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/\\?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
AUTHORITY = r"(?s)^//(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$"
DOT_SEGMENT = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"

# URLs made only of characters that stay as they are, without dot segments.
_SEGMENT = r"[A-Za-z0-9_~-][A-Za-z0-9_~.%-]*+"
_TAIL = r"(?:[?][A-Za-z0-9_~.&=%+/-]*+)?(?:#[A-Za-z0-9_~.&=%/-]*+)?$"
_SITE = r"https?://(?:[a-z0-9-]+[.])*[a-z][a-z0-9-]*"
_SEGMENTS = f"(?:{_SEGMENT}/)*+(?:{_SEGMENT})?"
PLAIN_ABSOLUTE = f"^{_SITE}/{_SEGMENTS}{_TAIL}"
PLAIN_ROOTED = f"^/{_SEGMENTS}{_TAIL}"
PLAIN_RELATIVE = f"^{_SEGMENT}(?:/{_SEGMENT})*+/?{_TAIL}"
PLAIN_SITE = f"^({_SITE})(?:[/?#].*)?$"
PLAIN_FOLDER = f"^({_SITE}/(?:{_SEGMENT}/)*+)(?:{_SEGMENT})?(?:[?#].*)?$"


def _percent_encode(text: str, unsafe: str) -> str:
    """Escape every character matching ``unsafe`` as its UTF-8 bytes."""
    octets = "regexp_replace(hex(encode(_c, 'UTF-8')), '(..)', '%$1')"
    escaped = f"array_join(transform(split(_t, ''), _c -> if(_c rlike r'{unsafe}', {octets}, _c)), '')"
    return sql_let("_t", text, f"if(_t rlike r'{unsafe}', {escaped}, _t)")


def _without_dots(path: str) -> str:
    """Fold '.' and '..' segments of an absolute path; most paths have none."""
    numbered = (
        "transform(_g, (_s, _i) -> named_struct('seg', _s, 'low', replace(lower(_s), '%2e', '.'),"
        " 'tail', if(_i = size(_g) - 1, array(''), cast(array() as array<string>))))"
    )
    fold = f"""aggregate({numbered}, cast(array() as array<string>), (_k, _x) -> case
        when _x.low = '.' then concat(_k, _x.tail)
        when _x.low = '..' then concat(slice(_k, 1, greatest(size(_k) - 1, 0)), _x.tail)
        else concat(_k, array(_x.seg)) end)"""
    folded = sql_let("_g", "split(substring(_p, 2), '/')", f"concat('/', array_join({fold}, '/'))")
    return sql_let("_p", path, f"if(_p rlike r'{DOT_SEGMENT}', {folded}, _p)")


def _clean(url: str) -> str:
    ends = rf"regexp_replace({url}, r'^[\x00-\x20]+|[\x00-\x20]+$', '')"
    return rf"regexp_replace({ends}, r'[\t\n\r]', '')"


def _slashes(url: str, base_scheme: str) -> str:
    """Bring the slash variants browsers accept into the plain ``scheme://host`` form."""
    parts = sql_fields(
        scheme="lower(regexp_extract(_r, '^([A-Za-z]+):', 1))",
        rest="regexp_replace(_r, '^[A-Za-z]+:', '')",
        special=f"_r rlike r'{SPECIAL}'",
    )
    relative = "if(_q.special, _q.rest, _r)"
    plain = rf"""case
        when _q.special and not (_q.scheme = {base_scheme} and not startswith(_q.rest, '//'))
          then concat(_q.scheme, '://', regexp_replace(_q.rest, r'^[/\\]*', ''))
        when {relative} rlike r'^[/\\]{{2}}' then regexp_replace({relative}, r'^[/\\]+', '//')
        else {relative} end"""
    odd = r"_r rlike r'^([A-Za-z]+:|[/\\]{2})' and not _r rlike r'^(?i)https?://[^/\\]'"
    return sql_let("_r", url, f"if({odd}, {sql_let('_q', parts, plain)}, _r)")


def _split(url: str) -> str:
    names = ("scheme", "authority", "path", "query", "fragment")
    parts = {name: f"regexp_extract({url}, r'{URL_PARTS}', {i})" for i, name in enumerate(names, 1)}
    parts["scheme"] = f"lower({parts['scheme']})"
    return sql_fields(**parts)


def _host_port(scheme: str, authority: str) -> str:
    """``//user@HOST:port`` in its normal form; null when it is not a valid host."""
    parts = sql_fields(
        user=f"regexp_extract({authority}, r'{AUTHORITY}', 1)",
        host=f"lower(regexp_extract({authority}, r'{AUTHORITY}', 2))",
        port=f"regexp_extract({authority}, r'{AUTHORITY}', 3)",
    )
    ports = ", ".join(f"'{name}', '{port}'" for name, port in DEFAULT_PORTS.items())
    number = "try_cast(_h.port as int)"
    checked = rf"""case when _h.host <> ''
          and (not _h.host rlike r'{FORBIDDEN_HOST}' or _h.host rlike r'^\[[0-9a-f:.]+\]$')
          and (_h.port = '' or (_h.port rlike '^[0-9]+$' and {number} <= 65535))
        then concat('//', if(_h.user = '', '', concat(_h.user, '@')), _h.host,
          if(_h.port = '' or cast({number} as string) = element_at(map({ports}), {scheme}),
             '', concat(':', cast({number} as string)))) end"""
    return sql_let("_h", parts, checked)


def _merge(r: str, b: str) -> str:
    """Combine split reference and split base; null when there is no valid URL."""
    opaque = f"""concat({r}.scheme, ':', {r}.authority, {_percent_encode(f"{r}.path", UNSAFE_OPAQUE)},
        {_percent_encode(f"{r}.query", UNSAFE_QUERY)}, {_percent_encode(f"{r}.fragment", UNSAFE_FRAGMENT)})"""
    own = f"({r}.scheme <> '' or {r}.authority <> '')"
    folder = rf"regexp_extract(replace({b}.path, r'\', '/'), '(?s)^(.*/)', 1)"
    parts = sql_fields(
        scheme=f"if({r}.scheme <> '', {r}.scheme, {b}.scheme)",
        authority=f"if({own}, {r}.authority, {b}.authority)",
        path=rf"""case when {own} or {r}.path rlike r'^[/\\]' then {r}.path
            when {r}.path = '' then {b}.path
            else concat({sql_let('_f', folder, "if(_f = '', '/', _f)")}, {r}.path) end""",
        query=f"if(not {own} and {r}.path = '' and {r}.query = '', {b}.query, {r}.query)",
        fragment=f"{r}.fragment",
    )
    slashed = r"replace(_m.path, r'\', '/')"
    rooted = f"concat(if(startswith({slashed}, '/'), '', '/'), {slashed})"
    whole = f"""case when concat(_m.scheme, ':') rlike r'{SPECIAL}' then concat(_m.scheme, ':',
        {_host_port("_m.scheme", "_m.authority")},
        {_percent_encode(_without_dots(rooted), UNSAFE_PATH)},
        {_percent_encode("_m.query", UNSAFE_QUERY)},
        {_percent_encode("_m.fragment", UNSAFE_FRAGMENT)}) end"""
    is_opaque = f"{r}.scheme <> '' and not concat({r}.scheme, ':') rlike r'{SPECIAL}'"
    return f"if({is_opaque}, {opaque}, {sql_let('_m', parts, whole)})"


def _resolve_sql() -> str:
    in_full = sql_let(
        "_b",
        sql_let("_u", _slashes(_clean("_a.base"), "''"), _split("_u")),
        sql_let(
            "_w",
            sql_let("_v", _slashes(_clean("_a.ref"), "_b.scheme"), _split("_v")),
            _merge("_w", "_b"),
        ),
    )
    return f"""case when _a.ref rlike r'{PLAIN_ABSOLUTE}' then _a.ref
        when _a.ref rlike r'{PLAIN_ROOTED}' and _a.base rlike r'{PLAIN_SITE}'
          then concat(regexp_extract(_a.base, r'{PLAIN_SITE}', 1), _a.ref)
        when _a.ref rlike r'{PLAIN_RELATIVE}' and _a.base rlike r'{PLAIN_FOLDER}'
          then concat(regexp_extract(_a.base, r'{PLAIN_FOLDER}', 1), _a.ref)
        else {in_full} end"""


RESOLVE = _resolve_sql()


def resolve(ref: Column, base: Column) -> Column:
    """``new URL(ref, base).href`` for web URLs; null where that would throw.

    Hosts are lower-cased but not converted to punycode.  Links made only of plain
    characters, by far the most, are answered without taking the URLs apart.
    """
    return sql_call(RESOLVE, ref=ref, base=base)


def absolute(ref: Column, base: Column) -> Column:
    """Like :func:`resolve`, but an unresolvable reference comes back unchanged."""
    return F.coalesce(resolve(ref, base), ref)


def encode_component(text: Column) -> Column:
    """encodeURIComponent: only letters, digits and ``-_.!~*'()`` stay literal."""
    encoded = F.url_encode(text)
    for found, literal in (
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ):
        encoded = F.replace(encoded, F.lit(found), F.lit(literal))
    return encoded


def normal(url: Column) -> Column:
    """The normalised form of an absolute web URL; null for anything else."""
    href = resolve(url, url)
    return F.when(url.rlike(r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:") & href.rlike("^https?://[^/]"), href)


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` in lower case, without an implied port."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]*)", 1))
    found = F.regexp_replace(found, "//[^@]*@", "//")
    return F.regexp_replace(F.regexp_replace(found, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")


def host(url: Column) -> Column:
    return F.regexp_extract(origin(url), r"//(\[[^\]]*\]|[^:]*)", 1)


def path_query(url: Column) -> Column:
    """Path (at least ``/``) plus query; the fragment is dropped."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]*([^#]*)", 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def _form_decode(text: str) -> str:
    return f"coalesce(try_url_decode({text}), {text})"


_PAIRS = f"""transform(
    filter(split(regexp_extract(_a.url, r'^[^?#]*\\?([^#]*)', 1), '&'), _q -> _q <> ''),
    _q -> named_struct('key', {_form_decode("regexp_extract(_q, '(?s)^([^=]*)', 1)")},
                       'val', {_form_decode("regexp_extract(_q, '(?s)^[^=]*=(.*)$', 1)")}))"""
_CHANGED = """if(array_position(transform(_p, _q -> _q.key), _a.name) > 0,
    transform(
      filter(_p, (_q, _i) -> _q.key <> _a.name or _i + 1 = array_position(transform(_p, _o -> _o.key), _a.name)),
      _q -> if(_q.key = _a.name, named_struct('key', _a.name, 'val', _a.val), _q)),
    concat(_p, array(named_struct('key', _a.name, 'val', _a.val))))"""
_WRITTEN = f"array_join(transform({_CHANGED}, _q -> concat(url_encode(_q.key), '=', url_encode(_q.val))), '&')"
_WITH_PARAM = f"""concat(regexp_extract(_a.url, '^([^?#]*)', 1), '?', {sql_let('_p', _PAIRS, _WRITTEN)},
    regexp_extract(_a.url, '(?s)(#.*)$', 1))"""


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, null when the URL has none."""
    found = f"get(filter({_PAIRS}, _q -> _q.key = _a.name), 0).val"
    return sql_call(found, url=url, name=F.lit(name))


def with_query_param(url: Column, name: str, value: Column) -> Column:
    """Set a parameter: first occurrence replaced, later ones dropped, else appended."""
    return sql_call(_WITH_PARAM, url=url, name=F.lit(name), val=value)


def fill_template(template: str, params: dict[str, Column]) -> Column:
    """``/tag/{name}`` with every ``{name}`` replaced by its encoded parameter."""
    pieces: list[Column] = []
    for text, key in re.findall(r"(.*?)(?:\{(\w+)\}|$)", template, flags=re.S | re.A):
        if text:
            pieces.append(F.lit(text))
        if key:
            message = f"{template} needs a value for {{{key}}}"
            if key not in params:
                raise ValueError(message)
            value = params[key].cast("string")
            pieces.append(
                F.when(value.isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(
                    encode_component(value)
                )
            )
    return F.concat(*pieces) if pieces else F.lit("")
