"""User code: value transforms and whole-table post-processing."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.spec import Resource, SiteSpec


def _where_known(fn: Callable, values: pd.Series, bases: pd.Series) -> pd.Series:
    """``fn`` of the values that are there; Spark hands over missing ones as well."""
    out = pd.Series([None] * len(values), dtype=object)
    known = values.notna().to_numpy()
    if known.any():
        out[known] = list(fn(values[known].reset_index(drop=True), bases[known].reset_index(drop=True)))
    return out


@dataclass(frozen=True)
class ValueHook:
    """A custom value transform.

    ``kind='column'`` functions build a column expression and stay in the JVM;
    ``kind='series'`` functions get pandas Series batches without missing values.
    Both receive the value and the page's base URL.
    """

    fn: Callable[[Any, Any], Any]
    returns: str = "string"
    kind: str = "column"

    def apply(self, value: Column, base: Column) -> Column:
        if self.kind == "column":
            return self.fn(value, base).cast(self.returns)
        fn = self.fn

        def one(values: pd.Series, bases: pd.Series) -> pd.Series:
            return _where_known(fn, values, bases)

        return F.pandas_udf(one, self.returns)(value, base)

    def apply_many(self, values: Column, base: Column) -> Column:
        if self.kind == "column":
            return F.transform(values, lambda v: self.apply(v, base))
        fn = self.fn

        def each(arrays: pd.Series, bases: pd.Series) -> pd.Series:
            sizes = arrays.map(len)
            flat = pd.Series([v for items in arrays for v in items], dtype=object)
            out = list(_where_known(fn, flat, bases.repeat(sizes).reset_index(drop=True)))
            stops = sizes.cumsum()
            return pd.Series([out[stop - n : stop] for n, stop in zip(sizes, stops)], dtype=object)

        return F.pandas_udf(each, f"array<{self.returns}>")(values, base)


def hook_transform(returns: str = "string", kind: str = "column") -> Callable[[Callable], ValueHook]:
    """Decorator: ``@hook_transform(returns="int")`` above ``def fn(value, base_url)``."""
    return lambda fn: ValueHook(fn, returns, kind)


@dataclass(frozen=True)
class PostContext:
    base_url: str
    spec: SiteSpec
    resource: Resource


PostProcess = Callable[[DataFrame, PostContext], DataFrame]


@dataclass(frozen=True)
class Hooks:
    transforms: Mapping[str, ValueHook] = field(default_factory=dict)
    post_process: Mapping[str, PostProcess] = field(default_factory=dict)


def load_hooks(path: str | Path, spark: SparkSession | None = None) -> Hooks:
    """Hooks from a Python file: its ``transforms`` / ``post_process``, or those of ``hooks``.

    Functions travel to the executors by value; with a session given, the file is
    shipped too, so that hook modules may import each other.
    """
    path = Path(path)
    loader = importlib.util.spec_from_file_location(path.stem, path)
    if loader is None or loader.loader is None:
        raise ImportError(f"cannot load hooks from {path}")
    module = importlib.util.module_from_spec(loader)
    loader.loader.exec_module(module)
    if spark is not None:
        spark.sparkContext.addPyFile(str(path))
    else:
        import sys

        sys.modules.setdefault(path.stem, module)
        cloudpickle.register_pickle_by_value(module)
    found = getattr(module, "hooks", module)
    as_hook = lambda h: h if isinstance(h, ValueHook) else ValueHook(h)
    return Hooks(
        {name: as_hook(h) for name, h in getattr(found, "transforms", {}).items()},
        dict(getattr(found, "post_process", {})),
    )


# ---- ready-made hooks ------------------------------------------------------

# The star-rating words of the sample catalogue.
RATING_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}


@hook_transform(returns="int")
def rating_word(value: Column, base: Column) -> Column:
    """``star-rating Three`` -> 3; anything else is null."""
    word = F.lower(F.trim(F.regexp_replace(value, "(?i)^(.*?)star-rating", "$1")))
    words = F.create_map(*[F.lit(x) for pair in RATING_WORDS.items() for x in pair])
    return F.try_element_at(words, word)


ROW_ORDER = ("_source", "_page_no", "_row_no")


def _order(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ROW_ORDER if c in df.columns]


def sort_by_number(column: str) -> PostProcess:
    """Ascending, missing counts as 0, ties keep their order."""

    def run(df: DataFrame, _: PostContext) -> DataFrame:
        return df.orderBy(F.coalesce(F.col(column), F.lit(0)), *_order(df))

    return run


def keep_first(n: int) -> PostProcess:
    def run(df: DataFrame, _: PostContext) -> DataFrame:
        return df.orderBy(*_order(df)).limit(n)

    return run


def dedupe_by(key: str) -> PostProcess:
    """One row per key: the last row's values at the first row's position.

    Two map-side-combined aggregates instead of a window, so that one very common
    key costs no more than its partial results.
    """

    def run(df: DataFrame, _: PostContext) -> DataFrame:
        order = _order(df)
        position = F.struct(*order)
        names = [c for c in df.columns if c not in ROW_ORDER]
        grouped = df.groupBy(F.col(key).alias("_key")).agg(
            F.max_by(F.struct(*names), position).alias("_row"), F.min(position).alias("_at")
        )
        return grouped.select(
            *[F.col(f"_at.{c}").alias(c) for c in ROW_ORDER if c in df.columns],
            *[F.col(f"_row.{c}").alias(c) for c in names],
        )

    return run
