"""Value transforms as column expressions (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters of the ECMAScript \s class.  Java's
# own \s covers the ASCII ones only.
WHITESPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
ALL_SPACES = "".join(re.findall(WHITESPACE, "".join(map(chr, range(0x10000))), re.ASCII))
# Whatever is not already a single plain space between two words.
UNEVEN = f"{WHITESPACE}{{2,}}|(?! ){WHITESPACE}"

# The built-in transform names and what each one returns.
BUILT_IN = {
    "trim": "string",
    "int": "bigint",
    "float": "double",
    "number": "double",
    "boolean": "boolean",
    "url": "string",
    "lower": "string",
    "upper": "string",
}

TRUE_WORDS = ("true", "yes", "1", "on")


def collapse(text: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, UNEVEN, " "))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(ALL_SPACES))


def first_number(text: Column) -> Column:
    """The first decimal number once commas and whitespace are gone, '' if none."""
    packed = F.regexp_replace(text, "," + "|" + WHITESPACE, "")
    return F.regexp_extract(packed, r"-?[0-9]+(?:[.][0-9]+)?", 0)


def to_float(text: Column) -> Column:
    return F.nullif(first_number(text), F.lit("")).try_cast("double")


def to_int(text: Column) -> Column:
    # the double-to-bigint cast drops the fraction, i.e. rounds toward zero
    return to_float(text).try_cast("bigint")


def to_boolean(text: Column) -> Column:
    return F.lower(trim(text)).isin(*TRUE_WORDS)


def number_text(number: Column) -> Column:
    """A double as ECMAScript prints it: no trailing '.0', exponents only past 1e21 or 1e-6."""
    plain = number.cast("string")
    size = F.abs(number)
    shortest = F.regexp_replace(plain, r"[.]0(?=E|$)", "")
    exponent = F.regexp_replace(F.regexp_replace(shortest, "E(?=[0-9])", "e+"), "E-", "e-")
    digits = F.when(size >= 1e15, plain.try_cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(plain.try_cast("decimal(38,22)").cast("string"), r"[.]?0+$", "")
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7), shortest)
        .when(number == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-6), exponent)
        .otherwise(digits)
    )


def as_text(value: Column, dtype: str) -> Column:
    """What a text transform sees: null is '', numbers and booleans print plainly."""
    if dtype == "string":
        text = value
    elif dtype == "double":
        text = number_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def apply_built_in(name: str, value: Column, dtype: str, base: Column) -> Column:
    text = as_text(value, dtype)
    if name == "trim":
        return trim(text)
    if name == "lower":
        return F.lower(text)
    if name == "upper":
        return F.upper(text)
    if name == "int":
        return to_int(text)
    if name in ("float", "number"):
        return to_float(text)
    if name == "boolean":
        return to_boolean(text)
    if name == "url":
        from pageloom.functions.urls import absolute

        return absolute(text, base)
    raise ValueError(f"not a built-in transform: {name}")
