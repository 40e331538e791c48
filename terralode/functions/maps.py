"""Column functions on maps and arrays: year histories, whitelists, denylists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def years_within(history: Column, years: Sequence[str]) -> Column:
    """The sorted distinct keys of a year map that lie in a window."""
    return F.array_sort(F.array_distinct(F.filter(F.map_keys(history), lambda y: y.isin(*years))))


def latest_value(history: Column) -> Column:
    """The value of the greatest key."""
    return F.try_element_at(history, F.array_max(F.map_keys(history)))


def keep_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def drop_private(m: Column, private: Sequence[str]) -> Column:
    """Without the keys of a denylist, whatever their case."""
    return F.map_filter(m, lambda k, _: ~F.lower(k).isin(*(p.lower() for p in private)))


def merged(left: Column, right: Column) -> Column:
    """Both maps; the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def adopted(flags: Column, yes: str = "Si") -> Column:
    """How many values say yes."""
    return F.size(F.filter(F.map_values(flags), lambda v: v == yes))


def displayable(m: Column, whitelist: Sequence[str] | None, labels: Mapping[str, str] | None = None) -> Column:
    """(label, value) structs of a map of properties: those of a whitelist in its order, without empty ones, under their
    labels; without a whitelist all but internal ones (__x), in order of their keys."""
    if whitelist is None:
        kept = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.startswith("__")))
        return F.transform(kept, lambda k: F.struct(k.alias("label"), F.element_at(m, k).alias("value")))
    pairs = F.array(*(F.struct(F.lit((labels or {}).get(k, k)).alias("label"), F.try_element_at(m, F.lit(k)).alias("value")) for k in whitelist))
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")


def strip_private(schema: DataType, c: Column, private: Sequence[str]) -> Column | None:
    """A struct without the fields of a denylist, whatever their case, at every level; null if none is left."""
    hidden = {p.lower() for p in private}
    fields = []
    for f in schema.fields:
        if f.name.lower() in hidden:
            continue
        inner = strip_private(f.dataType, c[f.name], private) if isinstance(f.dataType, StructType) else c[f.name]
        if inner is not None:
            fields.append(inner.alias(f.name))
    return F.struct(*fields) if fields else None


def first_of(m: Column, names: Sequence[str]) -> Column:
    """The first of several names under which a map has a value."""
    return F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names))


def json_kind(c: Column) -> Column:
    """What a JSON text is: the type of an object that has one, 'object' without, 'invalid' if it can't be parsed, 'none'
    if it is null."""
    sound = F.try_parse_json(c).isNotNull()
    return F.when(c.isNull(), "none").when(~sound, "invalid").otherwise(F.coalesce(F.get_json_object(c, "$.type"), F.lit("object")))
