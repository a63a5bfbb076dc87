"""Work on values at any depth of a column's type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_nested(value: Column, kind: T.DataType, wanted: type[T.DataType], f: Callable[[Column], Column]) -> Column:
    """value with f applied to everything of the wanted type, through structs, arrays and map values; all else stays."""
    if isinstance(kind, wanted):
        return f(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: apply_nested(x, kind.elementType, wanted, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: apply_nested(x, kind.valueType, wanted, f))
    if isinstance(kind, T.StructType):
        made = F.struct(*(apply_nested(value[c.name], c.dataType, wanted, f).alias(c.name) for c in kind.fields))
        return F.when(value.isNotNull(), made)
    return value


def apply_everywhere(df: DataFrame, wanted: type[T.DataType], f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(apply_nested(F.col(c.name), c.dataType, wanted, f).alias(c.name) for c in df.schema.fields))


def nested_values(df: DataFrame, wanted: type[T.DataType]) -> list[str]:
    """Paths of the fields of the wanted type; [] stands for an array's elements, {} for a map's values."""

    def walk(path: str, kind: T.DataType) -> list[str]:
        if isinstance(kind, wanted):
            return [path]
        if isinstance(kind, T.ArrayType):
            return walk(path + "[]", kind.elementType)
        if isinstance(kind, T.MapType):
            return walk(path + "{}", kind.valueType)
        if isinstance(kind, T.StructType):
            return [p for c in kind.fields for p in walk(f"{path}.{c.name}" if path else c.name, c.dataType)]
        return []

    return walk("", df.schema)
