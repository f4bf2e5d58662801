"""Nested settings as rows of flat names, and back, for tables of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(kind: T.StructType, value: Column | None, path: tuple[str, ...]) -> list[tuple[tuple[str, ...], Column]]:
    out = []
    for f in kind:
        own = F.col(f"`{f.name}`") if value is None else value[f.name]
        out += _leaves(f.dataType, own, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [((*path, f.name), own)]
    return out


def flatten_rows(df: DataFrame, key: str, separator: str = "/") -> DataFrame:
    """(key, name, value): a row a leaf, named by its path; a map's entries are leaves too, a null leaf has the value 'None'."""
    pairs = []
    rest = T.StructType([f for f in df.schema if f.name != key])
    for path, value in _leaves(rest, None, ()):
        kind = rest
        for p in path:
            kind = kind[p].dataType
        name = separator.join(path)
        text = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
        if isinstance(kind, T.MapType):
            entries = F.coalesce(F.map_entries(value), F.map_entries(F.create_map().cast(kind)))
            pairs.append(F.transform(entries, lambda e: F.struct(F.concat(F.lit(name + separator), e["key"].cast("string")).alias("name"), text(e["value"]).alias("value"))))
        else:
            pairs.append(F.array(F.struct(F.lit(name).alias("name"), text(value).alias("value"))))
    return df.select(key, F.explode(F.concat(*pairs)).alias("e")).select(key, "e.name", "e.value")


def unflatten_rows(rows: DataFrame, key: str, schema: T.StructType, separator: str = "/") -> DataFrame:
    """The nested columns again: values take the types of ``schema``; 'None' and missing names are null."""
    flat = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.nullif("value", F.lit("None")).alias("value")))).alias("m"))

    def build(kind: T.DataType, path: tuple[str, ...]) -> Column:
        name = separator.join(path)
        if isinstance(kind, T.StructType):
            return F.struct(*[build(f.dataType, (*path, f.name)).alias(f.name) for f in kind])
        if isinstance(kind, T.MapType):
            mine = F.map_filter("m", lambda k, _: k.startswith(name + separator))
            return F.transform_keys(mine, lambda k, _: F.substring(k, len(name + separator) + 1, 1 << 20)).cast(kind)
        return F.try_element_at("m", F.lit(name)).cast(kind)

    return flat.select(key, *[build(f.dataType, (f.name,)).alias(f.name) for f in schema])
