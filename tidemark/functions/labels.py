"""Label sets as one canonical string, so that series can be grouped and joined by a plain column.

``name<KV>value`` parts in order of name, joined by ``SEP``; empty values are absent labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP, KV, NAME = "\x02", "\x01", "__name__"


def parts(key: Column) -> Column:
    return F.split(key, SEP, -1)


def _name(part: Column) -> Column:
    return F.substring_index(part, KV, 1)


def joined(items: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(items, lambda p: p != F.lit(""))), SEP)


def from_columns(named: dict[str, Column]) -> Column:
    """The key of labels in columns; nulls and empty strings are absent."""
    items = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(n + KV), c.cast("string"))) for n, c in sorted(named.items())]
    return F.concat_ws(SEP, *items) if items else F.lit("")


def from_map(labels: Column) -> Column:
    entries = F.transform(F.map_entries(labels), lambda e: F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(e["key"], F.lit(KV), e["value"])).otherwise(F.lit("")))
    return joined(entries)


def to_map(key: Column) -> Column:
    """The label set as map<string,string>."""
    pairs = F.transform(F.filter(parts(key), lambda p: p != F.lit("")), lambda p: F.struct(_name(p).alias("key"), F.substring_index(p, KV, -1).alias("value")))
    return F.map_from_entries(pairs)


def get(key: Column, name: str) -> Column:
    """A label's value; absent reads as the empty string."""
    found = F.filter(parts(key), lambda p: F.startswith(p, F.lit(name + KV)))
    return F.coalesce(F.substring_index(F.get(found, F.lit(0)), KV, -1), F.lit(""))


def keep(key: Column, names: Sequence[str]) -> Column:
    if not names:
        return F.lit("")
    return F.array_join(F.filter(parts(key), lambda p: _name(p).isin(*names)), SEP)


def drop(key: Column, names: Sequence[str]) -> Column:
    if not names:
        return key
    return F.array_join(F.filter(parts(key), lambda p: ~_name(p).isin(*names)), SEP)


def put(key: Column, name: str, value: Column) -> Column:
    """Sets a label; an empty value deletes it."""
    rest = F.filter(parts(key), lambda p: _name(p) != F.lit(name))
    return joined(F.concat(rest, F.array(F.when(value != "", F.concat(F.lit(name + KV), value)).otherwise(F.lit("")))))
