"""Rows and typed columns out of page trees, without a shuffle.

Matching and reading happen inside one array expression per page, so only the
small raw values are exploded, never the tree.  Whitespace, transforms and the
missing-value policy then run as ordinary columns on those values.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.functions.cols import fields, join_span, let
from pageloom.hooks import Hooks
from pageloom.operators.selectors import attributes_used, members_used, page_predicate, select_ids, with_passes
from pageloom.operators.shred import shred
from pageloom.spec import Field, Resource, SpecError

WARNING_DDL = "struct<field:string,message:string>"
NO_WARNINGS = f"array<{WARNING_DDL}>"


@dataclass(frozen=True)
class TreeNeeds:
    """What a set of resources reads from the page tree."""

    attrs: frozenset[str]
    members: frozenset[str]
    markup: bool


def selectors_of(resource: Resource) -> list[str]:
    """All selectors a resource applies to a page."""
    found = [resource.row_selector, *[f.selector for f in resource.fields]]
    if resource.pagination and resource.pagination.type == "link":
        found.append(resource.pagination.selector)
    return [s for s in found if s]


def tree_needs(resources: Iterable[Resource]) -> TreeNeeds:
    attrs: set[str] = set()
    members = {"last"}
    markup = False
    for resource in resources:
        if resource.pagination and resource.pagination.type == "link":
            attrs.add("href")
            members.add("attrs")
        for selector in selectors_of(resource):
            attrs |= attributes_used(selector)
            members |= members_used(selector)
        for f in resource.fields:
            if f.attr:
                attrs.add(f.attr.lower())
                members.add("attrs")
            elif f.html:
                markup = True
                members |= {"h0", "h1"}
            else:
                members |= {"t0", "t1"}
    return TreeNeeds(frozenset(attrs), frozenset(members), markup)


def trees_for(pages: DataFrame, resources: Iterable[Resource], keep: Iterable[str]) -> DataFrame:
    """Page trees with just what the resources read."""
    resources = list(resources)
    needs = tree_needs(resources)
    trees = shred(pages, keep, needs.markup, needs.attrs, needs.members)
    return with_passes(trees, [s for r in resources for s in selectors_of(r)])


# ---- types -------------------------------------------------------------------


def value_type(f: Field, hooks: Hooks) -> str:
    """Type of one value: decided by the last transform that is known."""
    dtype = "string"
    for name in f.transform:
        if name in text.BUILT_IN:
            dtype = text.BUILT_IN[name]
        elif name in hooks.transforms:
            dtype = hooks.transforms[name].returns
    return dtype


def column_type(f: Field, hooks: Hooks) -> str:
    dtype = value_type(f, hooks)
    return f"array<{dtype}>" if f.many else dtype


def _default(f: Field, dtype: str) -> Column:
    value = f.default if f.has_default else None
    accepts = {"bigint": int, "double": (int, float), "boolean": bool, "string": (str, int, float)}
    if value is not None and dtype in accepts:
        right = isinstance(value, accepts[dtype])
        if not right or (isinstance(value, bool) and dtype != "boolean"):
            raise SpecError(f"field {f.name}: default {value!r} is not a {dtype}")
    return F.lit(value).cast(dtype)


# ---- reading -------------------------------------------------------------------


def read_node(f: Field, node: Column) -> Column:
    """Attribute, inner markup or text of one node; a missing attribute is ''."""
    if f.attr:
        return F.coalesce(F.try_element_at(node.attrs, F.lit(f.attr.lower())), F.lit(""))
    if f.html:
        return join_span(F.col("markup"), node.h0, node.h1)
    return join_span(F.col("texts"), node.t0, node.t1)


def _read_field(f: Field, row: Column | None) -> Column:
    nodes = F.col("nodes")
    if not f.selector:
        own = F.get(nodes, F.lit(0)) if row is None else row
        value = read_node(f, own)
        return F.array(value) if f.many else value
    ids = select_ids(page_predicate(f.selector), row)
    if f.many:
        return F.transform(ids, lambda i: read_node(f, F.get(nodes, i)))
    return let(
        F.get(ids, F.lit(0)), lambda i: F.when(i.isNotNull(), read_node(f, F.get(nodes, i)))
    )


def raw_rows(resource: Resource) -> Column:
    """All raw rows of a page as one array: list matches, or the single item."""

    def read(row: Column | None) -> Column:
        if not resource.fields:
            return fields(_=F.lit(True))
        return F.struct(*[_read_field(f, row).alias(f"f{i}") for i, f in enumerate(resource.fields)])

    if not resource.is_list:
        return F.array(read(None))
    nodes = F.col("nodes")
    rows = select_ids(page_predicate(resource.row_selector))
    return F.transform(rows, lambda i: let(F.get(nodes, i), read))


# ---- values ----------------------------------------------------------------------


def _value(f: Field, raw: Column, base: Column, hooks: Hooks) -> Column:
    dtype = "string"

    def each(step, values: Column) -> Column:
        return F.transform(values, step) if f.many else step(values)

    value = raw if f.html else each(text.collapse, raw)
    for name in f.transform:
        if name in text.BUILT_IN:
            given = dtype
            value = each(lambda v: text.apply_built_in(name, v, given, base), value)
            dtype = text.BUILT_IN[name]
        elif name in hooks.transforms:
            hook = hooks.transforms[name]
            value = hook.apply_many(value, base) if f.many else hook.apply(value, base)
            dtype = hook.returns
    if f.many:
        return value.cast(f"array<{dtype}>")
    return F.when(raw.isNull(), _default(f, dtype)).otherwise(value)


def _field_warnings(f: Field, raw: Column, hooks: Hooks) -> list[Column]:
    def warning(message: str) -> Column:
        return fields(field=F.lit(f.name), message=F.lit(message))

    found: list[Column] = []
    if f.selector and not (f.many or f.has_default or f.optional):
        missing = warning(f'no match for selector "{f.selector}"')
        found.append(F.when(raw.isNull(), F.array(missing)))
    unknown = [t for t in f.transform if t not in text.BUILT_IN and t not in hooks.transforms]
    if unknown:
        per_value = F.array(
            *[
                warning(f'unknown transform "{t}" (not built-in and not found in hooks)')
                for t in unknown
            ]
        )
        if f.many:
            found.append(F.flatten(F.array_repeat(per_value, F.size(raw))))
        else:
            found.append(F.when(raw.isNotNull(), per_value))
    return found


def row_warnings(resource: Resource, raw: Column, hooks: Hooks) -> Column:
    """One entry per missing required field and per value with an unknown transform."""
    none = F.array().cast(NO_WARNINGS)
    parts = [
        F.coalesce(w, none)
        for i, f in enumerate(resource.fields)
        for w in _field_warnings(f, raw[f"f{i}"], hooks)
    ]
    return F.concat(*parts).cast(NO_WARNINGS) if parts else none


def finish_rows(rows: DataFrame, resource: Resource, hooks: Hooks, keep: Iterable[str]) -> DataFrame:
    """Typed columns from exploded raw rows (``_raw`` struct, ``_base`` URL)."""
    values = [
        _value(f, F.col(f"_raw.f{i}"), F.col("_base"), hooks).alias(f.name)
        for i, f in enumerate(resource.fields)
    ]
    return rows.select(*keep, *values, row_warnings(resource, F.col("_raw"), hooks).alias("_warnings"))


def base_url(columns: Iterable[str]) -> Column:
    """The URL links are relative to: where the page was finally found."""
    if "final_url" in columns:
        return F.coalesce(F.col("final_url"), F.col("url"))
    return F.col("url")


def extract(
    trees: DataFrame, resource: Resource, keep: Iterable[str], hooks: Hooks | None = None
) -> DataFrame:
    """``keep`` + ``_row_no`` + one column per field + ``_warnings``, for every page."""
    keep = list(keep)
    rows = trees.select(
        *keep,
        base_url(trees.columns).alias("_base"),
        F.posexplode(raw_rows(resource)).alias("_row_no", "_raw"),
    )
    return finish_rows(rows, resource, hooks or Hooks(), [*keep, "_row_no"])


def warnings_of(extracted: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The warnings as a table of their own."""
    return extracted.select(*keep, F.inline("_warnings"))
