"""Maps whose later entries win, without the session-wide duplicate-key policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRING_MAP = "map<string,string>"


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), STRING_MAP)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it. Inside a
    lambda an expression is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns by way of a generator of one row. Filters are not moved through it, so what the
    columns say is computed once for each row, however many predicates name them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def last_wins(entries: Column) -> Column:
    """Map of an array of (key, value) entries; of equal keys the last one counts. Where keys repeat,
    entries are put in order of key and then of place, last first, and the first of each key is taken."""

    def of(all_):
        placed = F.sort_array(F.transform(all_, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("place"), e["value"].alias("value"))))
        first = let(placed, lambda p: F.filter(p, lambda e, i: (i == 0) | (e["key"] != F.get(p, i - 1)["key"])))
        kept = F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        differ = F.size(all_) == F.size(F.array_distinct(F.transform(all_, lambda e: e["key"])))
        return F.map_from_entries(F.when(differ, all_).otherwise(kept))

    return let(entries, of)


def merge(*maps: Column) -> Column:
    """Maps laid over one another, the rightmost on top. A null map adds nothing."""

    def over(low: Column, high: Column) -> Column:
        return let(high, lambda h: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(h, k)), h))

    return reduce(over, [F.coalesce(m, empty_map()) for m in maps])


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def series_key(tags: Column) -> Column:
    """The tag set as one comparable text: entries sorted by key, as JSON."""
    return F.to_json(sorted_entries(tags))


def shown(m: Column) -> Column:
    """k=v pairs in key order, for reports."""
    return F.array_join(F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
