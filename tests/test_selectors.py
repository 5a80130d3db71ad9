"""The one-pass form of selectors against the walking one, and its cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators.extract import extract, trees_for
from pageloom.operators.selectors import (
    attributes_used, compile_selector, members_used, needs_pass, page_predicate, select_ids, with_passes,
)
from pageloom.operators.shred import shred
from pageloom.spec import spec_from_dict

SELECTORS = [
    "b ~ i", "i ~ b ~ u", "div i u", "div div b", "div ~ div b i", "i + b ~ u, div u b", "div > i ~ b", "i ~ b > u",
    ".x ~ .y", "div .x .y i", "b:first-child ~ i:last-child", ":not(.x) ~ b", "[t] ~ [t=k]", "html body * *", "div i ~ u b",
    "i ~ *:nth-child(3)", "u b, i ~ i ~ i", "div div div div",
]


def random_page(random_):
    def node(depth):
        tag = random_.choice(["b", "i", "u", "div", "div"])
        attrs = random_.choice(["", " class=x", " class='y x'", " class=y", " t=k", " t"])
        inner = "".join(node(depth + 1) for _ in range(random_.randint(0, 4 if depth < 5 else 0)))
        return f"<{tag}{attrs}>{inner}t</{tag}>"

    return "".join(node(0) for _ in range(random_.randint(1, 5)))


def test_pass_equals_walk(spark):
    random_ = random.Random(8)
    pages = spark.createDataFrame([(i, random_page(random_)) for i in range(60)] + [(60, ""), (61, None)], "n int, html string")
    assert all(needs_pass(s) for s in SELECTORS) and not needs_pass("nav > ul + li a, b")
    attrs = set().union(*map(attributes_used, SELECTORS))
    members = set().union(*map(members_used, SELECTORS)) | {"parent", "idx"}
    passed = with_passes(shred(pages, ["n"], False, attrs, members), SELECTORS)
    both = passed.select(
        "n",
        *[select_ids(page_predicate(s)).alias(f"p{i}") for i, s in enumerate(SELECTORS)],
        *[select_ids(compile_selector(s)).alias(f"w{i}") for i, s in enumerate(SELECTORS)],
    ).collect()
    found = [0] * len(SELECTORS)
    for row in both:
        for i, s in enumerate(SELECTORS):
            assert row[f"p{i}"] == row[f"w{i}"], (s, row.n)
            found[i] += len(row[f"p{i}"])
    assert min(found) > 0 and len(both) == 62


@pytest.mark.parametrize("selector", ["li ~ li", "ul b", "body ul li ~ li b"])
def test_pass_is_linear(spark, selector):
    n = 50_000
    html = "<ul>" + "<li><b>x</b></li>" * n + "</ul>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    field = {"f": {"selector": selector, "many": True}}
    resource = spec_from_dict(
        {"name": "s", "baseUrl": "https://example.com", "resources": [{"name": "r", "fetch": {"path": "/"}, "item": {"fields": field}}]}
    ).resources[0]
    started = time.perf_counter()
    rows = extract(trees_for(pages, [resource], ["url"]), resource, []).select(F.size("f").alias("n")).collect()
    assert rows[0].n == (n if selector == "ul b" else n - 1)
    assert time.perf_counter() - started < 60
