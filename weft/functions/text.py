"""Small text functions of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_key(mention: Column) -> Column:
    return F.substring(F.lower(mention), 1, 2)


def relation_label(relation: Column) -> Column:
    return F.replace(relation, F.lit("_"), F.lit(" "))


def short_label(name: Column, most: int = 22) -> Column:
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(most - 1)), F.lit("…"))).otherwise(name)


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def counted(n: Column, noun: str) -> Column:
    return F.concat_ws(" ", n, F.when(n == 1, noun).otherwise(noun + "s"))


def trimmed(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def note_title(title: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(title), F.lit("")), F.lit("Untitled note"))
