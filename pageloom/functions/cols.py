"""Small helpers for building column expressions.

Large expressions are written as SQL text where that is easier to read; one parse
on the JVM side is also far quicker than building them call by call from Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain Python variable would be inlined at every use; a lambda argument is
    computed once, even when ``body`` uses it inside another lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(**named: Column) -> Column:
    return F.struct(*[col.alias(name) for name, col in named.items()])


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(name: str, value: str, body: str) -> str:
    """:func:`let` in SQL text: ``body`` may use ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_fields(**named: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in named.items()) + ")"


def sql_call(body: str, **args: Column) -> Column:
    """SQL text over columns: ``body`` names its arguments as ``_a.<name>``."""
    return F.get(F.call_function("transform", F.array(fields(**args)), F.expr(f"_a -> {body}")), F.lit(0))


def join_span(parts: Column, lo: Column, hi: Column) -> Column:
    """Concatenate ``parts[lo:hi]``, touching only those elements."""
    picked = F.transform(F.sequence(lo, hi - 1), lambda i: F.get(parts, i))
    return F.when(hi > lo, F.array_join(picked, "")).otherwise(F.lit(""))


def indexes(lo: Column, hi: Column) -> Column:
    """``[lo, hi)`` as an array of ints, empty when ``hi <= lo``."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
