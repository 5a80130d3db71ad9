"""CSS selectors as predicates on a page-tree node.

A selector becomes SQL text over a node expression and the page's ``nodes`` array.
Simple ones test ancestors by walking ``parent`` links from the node, which costs its
depth.  Those that would walk again and again (later siblings, nested descendants) are
decided for all nodes of a page at once: one pass in document order carries, for every
open level, which parts of the selector matched there, above it and among earlier
siblings, and leaves one bit per node.  Names in a selector may match elements outside
the row it is applied to, as in CSS.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.cols import indexes, sql_fields, sql_let, sql_text

# SQL of a node -> SQL of a boolean
Predicate = Callable[[str], str]

NAME = r"-?(?:[A-Za-z_]|[^\x00-\x7f]|\\.)(?:[\w-]|[^\x00-\x7f]|\\.)*"
TOKEN = re.compile(
    rf"""(?P<gap>\s*[>+~]\s*|\s+)
    |(?P<any>\*)
    |(?P<type>{NAME})
    |\.(?P<cls>{NAME})
    |\#(?P<id>{NAME})
    |\[\s*(?P<attr>{NAME})\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{NAME}|[\w-]+))\s*)?\]
    |:not\((?P<neg>[^()]+)\)
    |:nth-child\(\s*(?P<nth>\d+)\s*\)
    |:(?P<edge>first-child|last-child)
    """,
    re.VERBOSE,
)


class SelectorError(ValueError):
    """The selector uses a form this library does not support."""


@dataclass(frozen=True)
class Step:
    """One compound selector and how it relates to the one on its left."""

    relation: str
    tests: tuple[tuple[str, ...], ...]


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _split_groups(text: str) -> list[str]:
    """Cut at commas that are not inside brackets, parentheses or quotes."""
    groups, start = [""], re.compile(r"""\[[^\]]*\]|\([^)]*\)|"[^"]*"|'[^']*'|.""", re.S)
    for piece in start.findall(text):
        if piece == ",":
            groups.append("")
        else:
            groups[-1] += piece
    return [g.strip() for g in groups]


def _read_steps(text: str, whole: str) -> tuple[Step, ...]:
    steps: list[Step] = []
    relation, tests, at = "", [], 0
    while at < len(text):
        match = TOKEN.match(text, at)
        if not match:
            raise SelectorError(f"unsupported selector {whole!r} at {text[at:]!r}")
        at = match.end()
        part = match.groupdict()
        if part["gap"] is not None:
            if not tests:
                raise SelectorError(f"unsupported selector {whole!r}")
            steps.append(Step(relation, tuple(tests)))
            relation, tests = part["gap"].strip() or " ", []
        elif part["any"]:
            tests.append(("any",))
        elif part["type"]:
            if tests:
                raise SelectorError(f"unsupported selector {whole!r}")
            tests.append(("type", _plain(part["type"]).lower()))
        elif part["cls"]:
            tests.append(("class", _plain(part["cls"])))
        elif part["id"]:
            tests.append(("attr", "id", "=", _plain(part["id"])))
        elif part["attr"]:
            value = next((part[k] for k in ("dq", "sq", "bare") if part[k] is not None), "")
            tests.append(("attr", _plain(part["attr"]).lower(), part["op"] or "", value))
        elif part["neg"]:
            inner = _read_steps(part["neg"].strip(), whole)
            if len(inner) != 1 or len(inner[0].tests) != 1:
                raise SelectorError(f":not() takes one simple selector in {whole!r}")
            tests.append(("not", inner[0].tests[0]))
        elif part["nth"]:
            tests.append(("nth", part["nth"]))
        else:
            tests.append((part["edge"],))
    if not tests:
        raise SelectorError(f"unsupported selector {whole!r}")
    steps.append(Step(relation, tuple(tests)))
    return tuple(steps)


def parse_selector(selector: str) -> tuple[tuple[Step, ...], ...]:
    groups = _split_groups(selector)
    if not all(groups):
        raise SelectorError(f"empty selector in {selector!r}")
    return tuple(_read_steps(group, selector) for group in groups)


def attributes_used(selector: str) -> set[str]:
    """Attribute names a selector looks at (the class list is kept separately)."""

    def names(test: tuple) -> set[str]:
        if test[0] == "not":
            return names(test[1])
        return {test[1]} if test[0] == "attr" else set()

    return {
        name
        for steps in parse_selector(selector)
        for step in steps
        for test in step.tests
        for name in names(test)
    }


def members_used(selector: str) -> set[str]:
    """Parts of a node the compiled selector reads."""
    text = _pass_sql(selector) if needs_pass(selector) else compile_selector(selector)("n")
    return set(re.findall(r"\.(parent|last|depth|idx|prev|kids|tag|classes|attrs)\b", text))


def _test(test: tuple, n: str) -> str:
    kind = test[0]
    if kind == "any":
        return f"{n}.id > 0"
    if kind == "type":
        return f"{n}.tag = {sql_text(test[1])}"
    if kind == "class":
        return f"array_contains({n}.classes, {sql_text(test[1])})"
    if kind == "nth":
        return f"({n}.idx = {int(test[1]) - 1} and {n}.id > 0)"
    if kind == "first-child":
        return f"({n}.idx = 0 and {n}.id > 0)"
    if kind == "last-child":
        # ids are in document order, so the last child's subtree ends with its parent's
        return f"({n}.id > 0 and {n}.last = get(nodes, {n}.parent).last)"
    if kind == "not":
        return f"not {_test(test[1], n)}"
    _, name, op, value = test
    has = f"map_contains_key({n}.attrs, {sql_text(name)})"
    found = f"coalesce(try_element_at({n}.attrs, {sql_text(name)}), '')"
    wanted = sql_text(value)
    if op == "":
        return has
    if op == "=":
        return f"({has} and {found} = {wanted})"
    if value == "" or (op == "~=" and re.search(r"\s", value)):
        return "false"
    if op == "~=":
        return rf"array_contains(split({found}, r'\s+'), {wanted})"
    match = {"*=": "contains", "^=": "startswith", "$=": "endswith"}[op]
    return f"{match}({found}, {wanted})"


def _walk(n: str, link: str, count: str, accept: Predicate, level: int) -> str:
    """Follow ``link`` from node ``n`` for ``count`` nodes; does any satisfy ``accept``?"""
    acc, step = f"_acc{level}", f"_step{level}"
    here = f"get(nodes, {acc}.at)"
    start = f"named_struct('at', {n}.{link}, 'hit', false)"
    onward = f"named_struct('at', {here}.{link}, 'hit', {acc}.hit or coalesce({accept(here)}, false))"
    walked = f"aggregate(sequence(1, {count}), {start}, ({acc}, {step}) -> {onward}, {acc} -> {acc}.hit)"
    return f"if({count} > 0, {walked}, false)"


def _complex(steps: tuple[Step, ...], n: str, level: int = 0) -> str:
    own = " and ".join(_test(t, n) for t in steps[-1].tests)
    if len(steps) == 1:
        return f"({own})"
    relation, rest = steps[-1].relation, steps[:-1]

    def accept(node: str) -> str:
        return _complex(rest, node, level + 1)

    if relation == ">":
        left = f"{n}.depth > 1 and {accept(f'get(nodes, {n}.parent)')}"
    elif relation == "+":
        left = f"{n}.prev >= 0 and {accept(f'get(nodes, {n}.prev)')}"
    elif relation == "~":
        left = _walk(n, "prev", f"{n}.idx", accept, level)
    else:
        left = _walk(n, "parent", f"({n}.depth - 1)", accept, level)
    return f"({own} and coalesce({left}, false))"


def compile_selector(selector: str) -> Predicate:
    """The predicate for ``selector``; unsupported forms raise here, at plan time."""
    groups = parse_selector(selector)
    return lambda n: "(" + " or ".join(_complex(steps, n) for steps in groups) + ")"


# ---- one pass over a page -------------------------------------------------------

# parts of a selector are bits of one number
MOST_PARTS = 60


def needs_pass(selector: str) -> bool:
    """Would the walking predicate visit nodes over and over?"""
    groups = parse_selector(selector)
    walks = [[step.relation for step in steps[1:]] for steps in groups]
    slow = any("~" in relations or relations.count(" ") > 1 for relations in walks)
    return slow and sum(map(len, groups)) <= MOST_PARTS


def _pass_name(selector: str) -> str:
    return f"_pass_{zlib.crc32(selector.encode()):08x}"


def _pass_sql(selector: str) -> str:
    """An array of longs with a bit for every node id: does it match?

    Three arrays by depth hold bits of selector parts: ``own`` what the last node there
    matched, ``up`` that or any ancestor of it, ``sib`` that or any earlier sibling.  A node
    reads the levels of its parent and its previous sibling, and cuts off what is deeper.
    """
    bits, ends, at = [], 0, 0
    for steps in parse_selector(selector):
        for i, step in enumerate(steps):
            tests = [f"coalesce({_test(t, '_n')}, false)" for t in step.tests]
            if i:
                side = {">": "above", " ": "over", "+": "left", "~": "before"}[step.relation]
                tests.append(f"(_s.{side} & {1 << (at - 1)}L) != 0")
            bits.append(f"if({' and '.join(tests)}, {1 << at}L, 0L)")
            at += 1
        ends |= 1 << (at - 1)
    none = "cast(array() as array<bigint>)"
    start = sql_fields(own="array(0L)", up="array(0L)", sib="array(0L)", word="0L", words=none)

    def level(name: str, depth: str) -> str:
        return f"coalesce(get(_a.{name}, {depth}), 0L)"

    seen = sql_fields(
        above=level("own", "_n.depth - 1"),
        over=level("up", "_n.depth - 1"),
        left=f"if(_n.prev >= 0, {level('own', '_n.depth')}, 0L)",
        before=f"if(_n.prev >= 0, {level('sib', '_n.depth')}, 0L)",
    )

    def put(name: str, value: str) -> str:
        return f"concat(slice(_a.{name}, 1, _n.depth), array({value}))"

    word = f"_a.word | if((_m & {ends}L) != 0, shiftleft(1L, _n.id % 64), 0L)"
    onward = sql_fields(
        own=put("own", "_m"),
        up=put("up", "_s.over | _m"),
        sib=put("sib", "_s.before | _m"),
        word="if(_n.id % 64 = 63, 0L, _w)",
        words="if(_n.id % 64 = 63, concat(_a.words, array(_w)), _a.words)",
    )
    step = sql_let("_s", seen, sql_let("_m", " | ".join(bits), sql_let("_w", word, onward)))
    merge = f"(_a, _n) -> if(_n.id = 0, _a, {step})"
    return f"aggregate(nodes, {start}, {merge}, _a -> concat(_a.words, array(_a.word)))"


def with_passes(trees: DataFrame, selectors: Iterable[str | None]) -> DataFrame:
    """``trees`` with the passes that :func:`page_predicate` reads, each made once per page."""
    passes = {_pass_name(s): _pass_sql(s) for s in selectors if s and needs_pass(s)}
    if not passes:
        return trees
    # a generator, as a plain column would be copied into every lambda that reads it
    made = F.struct(*[F.expr(sql).alias(name) for name, sql in passes.items()])
    return trees.select("*", F.inline(F.array(made)))


def page_predicate(selector: str) -> Predicate:
    """The predicate for ``selector`` on trees that went through :func:`with_passes`."""
    if not needs_pass(selector):
        return compile_selector(selector)
    name = _pass_name(selector)
    return lambda n: f"(shiftright(get({name}, cast({n}.id div 64 as int)), {n}.id % 64) & 1L) = 1L"


def _span(within: Column | None) -> Column:
    """Ids to visit: the page, or the strict subtree of one node."""
    if within is None:
        return F.expr("if(size(nodes) > 1, sequence(1, size(nodes) - 1), cast(array() as array<int>))")
    return indexes(within.id + 1, within["last"] + 1)


def select_ids(matches: Predicate, within: Column | None = None) -> Column:
    """Ids of matching nodes in document order, of the page or of the subtree of ``within``.

    Only the subtree itself is visited, so a page's rows together cost one pass
    over the page per field.
    """
    return F.call_function("filter", _span(within), F.expr(f"_i -> {matches('get(nodes, _i)')}"))


def any_match(matches: Predicate, within: Column) -> Column:
    """Does anything in the subtree of ``within`` match?"""
    return F.call_function("exists", _span(within), F.expr(f"_i -> {matches('get(nodes, _i)')}"))
