"""Attributes are maps from string to string; sets of them are compared without regard to order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(attrs: Column, key: str, value: Column) -> Column:
    """Add or replace a key."""
    return F.map_concat(remove(attrs, key), F.create_map(F.lit(key), value))


def remove(attrs: Column, *keys: str) -> Column:
    return F.map_filter(attrs, lambda k, _: ~k.isin(*keys))


def keep(attrs: Column, keys) -> Column:
    return F.map_filter(attrs, lambda k, _: k.isin(*keys))


def canonical(attrs: Column) -> Column:
    """Sorted entries: equal for equal sets."""
    return F.array_sort(F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))))


def same(a: Column, b: Column, *ignored: str) -> Column:
    x, y = canonical(remove(a, *ignored)), canonical(remove(b, *ignored))
    return (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)


def set_hash(attrs: Column) -> Column:
    """Hash of a set, whatever its order."""
    return F.aggregate(canonical(attrs), F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(F.xxhash64(e["key"], e["value"])))


def dictionary(rows: DataFrame, attrs_col: str = "attrs", known: DataFrame | None = None) -> DataFrame:
    """Distinct attribute sets (text, type_id) with ids from 1 in the order of their canonical text; 0 stands for the empty set.

    With ``known``, an earlier dictionary, only sets that it has not got, with ids after its own.
    """
    from waymark.storage import numbered

    text = F.to_json(canonical(F.col(attrs_col)))
    distinct = rows.select(text.alias("text")).where("text <> '[]'").distinct()
    start = 1
    if known is not None:
        distinct = distinct.join(known.select("text"), "text", "left_anti")
        start += known.agg(F.max("type_id")).first()[0] or 0
    return numbered(distinct, "text", start=start).withColumnRenamed("id", "type_id")
