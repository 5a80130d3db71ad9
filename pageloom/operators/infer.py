"""Draft site descriptions from page structure, for every page of a table at once.

Repeating siblings are found and scored inside each page's own row: members are
sorted by (parent, signature), runs of equal keys become groups, and only the
first few members of real groups are measured.  No node leaves its page, so there
is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import names, text, urls
from pageloom.functions.cols import fields, indexes, join_span, let
from pageloom.operators.extract import base_url
from pageloom.operators.selectors import any_match, compile_selector, select_ids
from pageloom.operators.shred import shred

# What the heuristics look at.
ATTRS = ("class", "rel", "href", "src", "name", "content")
MEMBERS = ("parent", "last", "depth", "kids", "tag", "classes", "attrs", "t0", "t1")

# ---- fixed values: the scoring rule -------------------------------------------
MIN_CHILDREN, MAX_CHILDREN, MIN_GROUP = 3, 600, 3
SAMPLE = 5
TEXT_CAP = 200
HEADING_BONUS, IMAGE_BONUS, PRICE_BONUS, LINK_BONUS = 50, 30, 40, 10
PER_ELEMENT = 3

# ---- fixed values: selectors and words a draft is made of ----------------------
HEADING_SELECTOR = "h1,h2,h3,h4,h5,h6"
PRICE_SELECTOR = '[class*="price"]'
PAGE_TITLE_SELECTOR = "h1,h2,title"
DESCRIPTION_SELECTOR = 'meta[name="description"]'
NEXT_SELECTOR = 'a[rel="next"]'
NEXT_TEXT = "^(next|more|older|»|→)"
NEXT_CLASS = r"\b(next|more)\b"
LIST_NOTE = "Rows were found by repetition; check their selector and the fields."
ITEM_NOTE = "Nothing repeats on this page; the fields describe it as a whole."
SITE_NOTE = ("Drafted from ", " by structure alone; check it before use.")

FIELD_DDL = "array<struct<field:string,selector:string,attr:string,transform:array<string>>>"


def _text(node: Column) -> Column:
    return join_span(F.col("texts"), node.t0, node.t1)


def _has_text(node: Column) -> Column:
    return text.trim(_text(node)) != ""


def _within(selector: str, row: Column) -> Column:
    return select_ids(compile_selector(selector), row)


def _any_within(selector: str, row: Column) -> Column:
    return any_match(compile_selector(selector), row)


# ---- groups ------------------------------------------------------------------------


def _richness(row: Column) -> Column:
    """How much content one candidate row holds."""

    def bonus(selector: str, points: int) -> Column:
        return F.when(_any_within(selector, row), F.lit(points)).otherwise(F.lit(0))

    return (
        F.least(F.length(text.collapse(_text(row))), F.lit(TEXT_CAP))
        + bonus(HEADING_SELECTOR, HEADING_BONUS)
        + bonus("img", IMAGE_BONUS)
        + bonus(PRICE_SELECTOR, PRICE_BONUS)
        + PER_ELEMENT * (row["last"] - row.id)
        + bonus("a", LINK_BONUS)
    )


def _members(nodes: Column, max_children: int | None) -> Column:
    """Elements that may be list rows, ordered by (parent, signature, document order)."""
    body = F.get(F.filter(nodes, lambda n: (n.tag == "body") & (n.depth == 2)), F.lit(0))

    def inside(b: Column) -> Column:
        def eligible(n: Column) -> Column:
            siblings = F.get(nodes, n.parent).kids
            enough = siblings >= MIN_CHILDREN
            if max_children is not None:
                enough = enough & (siblings <= max_children)
            return (n.parent > b.id) & (n.parent <= b["last"]) & enough & ~n.tag.isin("script", "style")

        return F.array_sort(
            F.transform(
                F.filter(nodes, eligible),
                lambda n: fields(parent=n.parent, signature=names.signature(n.tag, n.classes), id=n.id),
            )
        )

    return let(body, inside)


def sibling_group_array(max_children: int | None = MAX_CHILDREN) -> Column:
    """``array<struct<score, parent, first_id, signature, n>>`` of one page.

    A draft passes over parents of more than ``max_children`` elements; None takes every parent.
    """
    nodes = F.col("nodes")

    def score(members: Column, start: Column, n: Column) -> Column:
        sample = indexes(start, start + F.least(n, F.lit(SAMPLE)))
        total = F.aggregate(
            sample,
            F.lit(0),
            lambda acc, i: acc + let(F.get(nodes, F.get(members, i).id), _richness),
        )
        return (total / F.least(n, F.lit(SAMPLE))) * (1 + F.log2(n.cast("double")))

    def group(members: Column, starts: Column) -> Column:
        def bounds(start: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(starts, i + 1), F.size(members))
            return fields(start=start, n=stop - start)

        runs = F.filter(F.transform(starts, bounds), lambda g: g.n >= MIN_GROUP)

        def describe(g: Column) -> Column:
            first = F.get(members, g.start)
            return fields(
                score=score(members, g.start, g.n),
                parent=first.parent,
                first_id=first.id,
                signature=first.signature,
                n=g.n,
            )

        return F.transform(runs, describe)

    def run_starts(members: Column) -> Column:
        def begins(i: Column) -> Column:
            here, before = F.get(members, i), F.get(members, i - 1)
            return (i == 0) | (here.parent != before.parent) | (here.signature != before.signature)

        return F.filter(indexes(F.lit(0), F.size(members)), begins)

    return let(_members(nodes, max_children), lambda m: let(run_starts(m), lambda s: group(m, s)))


def best_of(groups: Column) -> Column:
    """Highest score; ties go to the earliest parent, then the earliest first row."""
    ranked = F.transform(
        groups, lambda g: fields(score=g.score, parent=-g.parent, first=-g.first_id, group=g)
    )
    return let(F.array_max(ranked), lambda best: best.group)


def sibling_groups(
    trees: DataFrame, keep: Iterable[str], max_children: int | None = MAX_CHILDREN
) -> DataFrame:
    """Every repeating sibling group of every page, with its score."""
    return trees.select(*keep, F.inline(sibling_group_array(max_children)))


def best_groups(trees: DataFrame, keep: Iterable[str], max_children: int | None = MAX_CHILDREN) -> DataFrame:
    """The best group of every page that has one."""
    best = F.filter(F.array(best_of(sibling_group_array(max_children))), lambda g: g.isNotNull())
    return trees.select(*keep, F.inline(best))


# ---- fields ------------------------------------------------------------------------


def _field(name: str, selector: str | None = None, attr: str | None = None, *transform: str) -> Column:
    steps = F.array(*[F.lit(t) for t in transform]) if transform else F.lit(None)
    return fields(
        field=F.lit(name),
        selector=F.lit(selector).cast("string"),
        attr=F.lit(attr).cast("string"),
        transform=steps.cast("array<string>"),
    )


def _one_if(condition: Column, field: Column) -> Column:
    return F.when(condition, F.array(field)).otherwise(F.array().cast(FIELD_DDL))


def row_fields(row: Column) -> Column:
    """Fields that can be read from a list row."""
    nodes = F.col("nodes")

    def first_has_text(selector: str) -> Column:
        first = F.get(_within(selector, row), F.lit(0))
        return let(first, lambda i: F.when(i.isNotNull(), _has_text(F.get(nodes, i))).otherwise(F.lit(False)))

    heading = first_has_text(HEADING_SELECTOR)
    named_link = F.exists(_within("a", row), lambda i: _has_text(F.get(nodes, i)))
    title = F.when(heading, F.array(_field("title", HEADING_SELECTOR))).otherwise(
        _one_if(named_link, _field("title", "a"))
    )
    found = F.concat(
        title,
        _one_if(_any_within("a[href]", row), _field("url", "a", "href", "url")),
        _one_if(first_has_text(PRICE_SELECTOR), _field("price", PRICE_SELECTOR, None, "float")),
        _one_if(_any_within("img[src]", row), _field("image", "img", "src", "url")),
    )
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(_field("text"))))


def page_fields() -> Column:
    """Fields of a page without a list."""
    nodes = F.col("nodes")
    first = F.get(select_ids(compile_selector(DESCRIPTION_SELECTOR)), F.lit(0))
    content = let(first, lambda i: F.try_element_at(F.get(nodes, i).attrs, F.lit("content")))
    return F.concat(
        F.array(_field("title", PAGE_TITLE_SELECTOR)).cast(FIELD_DDL),
        _one_if(F.coalesce(content != "", F.lit(False)), _field("description", DESCRIPTION_SELECTOR, "content")),
    )


def first_row(group: Column) -> Column:
    """The first node of the whole page that the group's selector matches."""
    nodes = F.col("nodes")

    def like(member: Column) -> Column:
        wanted = F.slice(names.plain_classes(member.classes), 1, 2)
        same = lambda tag, classes: F.filter(
            nodes,
            lambda n: (n.tag == tag) & F.forall(classes, lambda c: F.array_contains(n.classes, c)),
        )
        return let(fields(tag=member.tag, classes=wanted), lambda w: F.get(same(w.tag, w.classes), F.lit(0)))

    return let(F.get(nodes, group.first_id), like)


def pagination_selector() -> Column:
    """Selector of the link to the next page, null if none is recognised."""
    nodes = F.col("nodes")

    def candidate(i: Column) -> Column:
        def of(n: Column) -> Column:
            own = F.array_join(F.transform(n.classes, F.lower), " ")
            looks_next = F.lower(text.trim(_text(n))).rlike(NEXT_TEXT) | own.rlike(NEXT_CLASS)
            parent_class = F.get(names.plain_classes(F.get(nodes, n.parent).classes), F.lit(0))
            own_class = F.get(names.plain_classes(F.transform(n.classes, F.lower)), F.lit(0))
            selector = F.coalesce(
                F.concat(F.lit("."), parent_class, F.lit(" a")), F.concat(F.lit("a."), own_class)
            )
            return F.when(looks_next, selector)

        return let(F.get(nodes, i), of)

    marked = F.size(select_ids(compile_selector(NEXT_SELECTOR))) > 0
    links = select_ids(compile_selector("a"))
    usable = F.filter(F.transform(links, candidate), lambda s: s.isNotNull())
    return F.when(marked, F.lit(NEXT_SELECTOR)).otherwise(F.get(usable, F.lit(0)))


# ---- drafts --------------------------------------------------------------------------


def _draft(url: Column, group: Column) -> Column:
    """A site description for one page as JSON, in the form :func:`parse_spec` reads."""

    def field_map(found: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                found,
                lambda f: fields(
                    key=f.field, value=fields(selector=f.selector, attr=f.attr, transform=f["transform"])
                ),
            )
        )

    paging = F.when(
        group.isNotNull(),
        let(
            pagination_selector(),
            lambda s: F.when(
                s.isNotNull(), fields(type=F.lit("link"), selector=s, maxPages=F.lit(1))
            ),
        ),
    )
    is_list = group.isNotNull()
    rows = F.when(
        is_list,
        fields(selector=group.signature, fields=field_map(let(first_row(group), row_fields))),
    )
    item = F.when(~is_list, fields(fields=field_map(page_fields())))
    resource = fields(
        name=F.when(is_list, F.lit("items")).otherwise(F.lit("page")),
        description=F.when(is_list, F.lit(LIST_NOTE)).otherwise(F.lit(ITEM_NOTE)),
        fetch=fields(path=urls.path_query(url), pagination=paging),
        list=rows,
        item=item,
    )
    site = urls.origin(url)
    return F.to_json(
        fields(
            name=names.site_name(urls.host(url)),
            baseUrl=site,
            description=F.concat(F.lit(SITE_NOTE[0]), site, F.lit(SITE_NOTE[1])),
            resources=F.array(resource),
        )
    )


def infer_trees(pages: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    """Page trees with just what the heuristics read."""
    carried = dict.fromkeys([*keep, *[c for c in ("url", "final_url") if c in pages.columns]])
    return shred(pages, carried, markup=False, attrs=ATTRS, members=MEMBERS)


def inferred_fields(trees: DataFrame, keep: Iterable[str]) -> DataFrame:
    """``keep, selector, fields`` per page; selector is null for page-level fields."""

    def describe(group: Column) -> Column:
        found = F.when(group.isNotNull(), let(first_row(group), row_fields)).otherwise(page_fields())
        return fields(selector=group.signature, fields=found)

    return trees.select(*keep, F.inline(F.array(let(best_of(sibling_group_array()), describe))))


def inferred_pagination(trees: DataFrame, keep: Iterable[str]) -> DataFrame:
    return trees.select(*keep, pagination_selector().alias("selector"))


def infer_drafts(pages: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    """``keep`` + ``draft``: one JSON site description per page, for review."""
    trees = infer_trees(pages, keep)
    where = base_url(trees.columns)
    draft = let(
        fields(url=urls.resolve(where, where)),
        lambda page: let(best_of(sibling_group_array()), lambda g: _draft(page.url, g)),
    )
    return trees.select(*keep, draft.alias("draft"))
