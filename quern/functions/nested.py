"""Nested records to dotted columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, depth: int = 3) -> DataFrame:
    """Struct fields as columns with dotted names, to a depth; what is deeper, and arrays, as JSON strings."""

    def walk(column: Column, name: str, kind: T.DataType, level: int) -> list[Column]:
        if isinstance(kind, T.StructType) and level < depth:
            return [c for f in kind.fields for c in walk(column.getField(f.name), f"{name}.{f.name}", f.dataType, level + 1)]
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return [F.to_json(column).alias(name)]
        return [column.alias(name)]

    return df.select(*[c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f.name, f.dataType, 1)])


def unflatten(df: DataFrame) -> DataFrame:
    """Dotted names as nested structs; the order of first appearance stays."""

    def build(items: list[tuple[list[str], str]]) -> list[Column]:
        groups: dict[str, list[tuple[list[str], str]]] = {}
        for path, name in items:
            groups.setdefault(path[0], []).append((path[1:], name))
        return [(F.col(f"`{some[0][1]}`") if not some[0][0] else F.struct(*build(some))).alias(head) for head, some in groups.items()]

    return df.select(*build([(c.split("."), c) for c in df.columns]))
