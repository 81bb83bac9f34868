"""Arrays of one row as small tables: values bound once, first items, and runs of items behind a head."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often ``use`` refers to it, within lambdas too."""
    return F.transform(F.array(value), use)[0]


def first_where(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """The first item for which ``wanted`` holds; null if there is none."""
    return F.get(F.filter(items, wanted), F.lit(0))


def headed(items: Column, head_of: Callable[[Column], Column]) -> Column:
    """Array of (head, item, rest): for each item that ``head_of`` gives a value for, that value, the item, and the items up to the next such one.

    Items before the first head belong to none. Items are worked out once a row, not once a head."""
    return bound(items, lambda once: _headed(once, head_of))


def _headed(items: Column, head_of: Callable[[Column], Column]) -> Column:
    def runs(marks: Column) -> Column:
        end = lambda k: F.coalesce(F.get(marks, k + 1)["at"], F.size(items))
        one = lambda m, k: F.struct(m["head"].alias("head"), F.get(items, m["at"]).alias("item"), F.slice(items, m["at"] + 2, end(k) - m["at"] - 1).alias("rest"))
        return F.transform(marks, one)

    marks = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("at"), head_of(x).alias("head"))), lambda m: m["head"].isNotNull())
    return bound(marks, runs)
