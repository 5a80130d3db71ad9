"""Names derived from hosts, classes, user agents and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import WHITESPACE

# Fixed value: class names that can be written in a selector as they are.
PLAIN_CLASS = r"^[a-zA-Z][a-zA-Z0-9_-]*$"


def agent_token(user_agent: Column) -> Column:
    """The product token robots groups are matched against."""
    return F.lower(F.regexp_extract(user_agent, f"^((?!{WHITESPACE})[^/(])*", 0))


def token_of(user_agent: str) -> str:
    """:func:`agent_token` for a setting known on the driver."""
    return re.split(r"[\s/(]", user_agent, maxsplit=1)[0].lower()


def site_name(host: Column) -> Column:
    return F.split_part(F.regexp_replace(host, r"^www\.", ""), F.lit("."), F.lit(1))


def plain_classes(classes: Column) -> Column:
    return F.filter(classes, lambda c: c.rlike(PLAIN_CLASS))


def split_classes(class_attr: Column) -> Column:
    return F.filter(F.split(class_attr, WHITESPACE + "+"), lambda c: c != "")


def first_class(class_attr: Column) -> Column:
    """The first class usable in a selector, null if there is none."""
    return F.get(plain_classes(split_classes(class_attr)), F.lit(0))


def signature(tag: Column, classes: Column) -> Column:
    """Tag plus up to two usable classes, as a selector."""
    picked = F.slice(plain_classes(classes), 1, 2)
    return F.concat(tag, F.array_join(F.transform(picked, lambda c: F.concat(F.lit("."), c)), ""))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)
