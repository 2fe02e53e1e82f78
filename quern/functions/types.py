"""Type names of several systems to Spark's, nested to ten levels; a name that isn't known is a string, with a warning, never an error."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import types as T

# Usual names of column types; below, those that mean something else in one system.
NAMES = {
    "tinyint": T.ByteType(), "int8": T.ByteType(), "smallint": T.ShortType(), "int16": T.ShortType(), "int2": T.ShortType(), "uint8": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int32": T.IntegerType(), "int4": T.IntegerType(), "uint16": T.IntegerType(), "serial": T.IntegerType(),
    "bigint": T.LongType(), "int64": T.LongType(), "long": T.LongType(), "uint32": T.LongType(), "bigserial": T.LongType(), "hugeint": T.DecimalType(38, 0), "uint64": T.DecimalType(20, 0), "ubigint": T.DecimalType(20, 0),
    "float": T.FloatType(), "float4": T.FloatType(), "real": T.FloatType(), "float16": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float8": T.DoubleType(), "float64": T.DoubleType(), "double precision": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "string": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "char": T.StringType(), "bpchar": T.StringType(), "utf8": T.StringType(), "large_utf8": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(), "time": T.StringType(),
    "date": T.DateType(), "date32": T.DateType(), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "bytea": T.BinaryType(), "blob": T.BinaryType(), "interval": T.DayTimeIntervalType(), "decimal": T.DecimalType(38, 18), "numeric": T.DecimalType(38, 18),
}
SYSTEMS = {
    "arrow": {"time32": T.StringType(), "time64": T.StringType(), "halffloat": T.FloatType(), "large_string": T.StringType(), "large_binary": T.BinaryType(), "date64": T.TimestampNTZType()},
    "postgres": {"int8": T.LongType(), "float": T.DoubleType(), "character varying": T.StringType(), "character": T.StringType(), "name": T.StringType(), "oid": T.LongType(), "smallserial": T.ShortType(), "money": T.DecimalType(19, 2), "timetz": T.StringType()},
    "duckdb": {"int8": T.LongType(), "int1": T.ByteType(), "signed": T.IntegerType(), "short": T.ShortType(), "utinyint": T.ShortType(), "usmallint": T.IntegerType(), "uinteger": T.LongType(), "decimal": T.DecimalType(18, 3), "numeric": T.DecimalType(18, 3), "bytea": T.BinaryType()},
    "spark": {"byte": T.ByteType(), "short": T.ShortType(), "timestamp": T.TimestampType(), "timestamp_ltz": T.TimestampType(), "decimal": T.DecimalType(10, 0), "numeric": T.DecimalType(10, 0), "void": T.NullType()},
}
MAX_DEPTH = 10


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def parse_type(text: str, system: str = "arrow", depth: int = 0) -> T.DataType:
    """system: arrow, postgres, duckdb or spark (Hive's, Glue's and Unity's names too)."""
    t = str(text).strip().lower()
    if depth < MAX_DEPTH:
        if t.endswith("[]"):
            return T.ArrayType(parse_type(t[:-2], system, depth + 1))
        if m := re.fullmatch(r"(?:array|list)\s*<(.*)>", t, re.S):
            return T.ArrayType(parse_type(m[1], system, depth + 1))
        if (m := re.fullmatch(r"map\s*[<(](.*)[>)]", t, re.S)) and len(kv := _split(m[1])) == 2:
            return T.MapType(parse_type(kv[0], system, depth + 1), parse_type(kv[1], system, depth + 1))
        if m := re.fullmatch(r"(?:struct|row)\s*[<(](.*)[>)]", t, re.S):
            fields = [re.fullmatch(r"\s*([\"`]?)(\w+)\1\s*[: ]\s*(.+)", f, re.S) for f in _split(m[1])]
            if fields and all(fields):
                return T.StructType([T.StructField(f[2], parse_type(f[3], system, depth + 1)) for f in fields])
    if (m := re.fullmatch(r"(?:decimal|numeric)(?:128)?\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", t)) and 1 <= int(m[1]) <= 38 and int(m[2] or 0) <= int(m[1]):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if m := re.fullmatch(r"timestamp\s*\[\s*(?:s|ms|us|ns)\s*(,\s*.+)?\]", t):
        return T.TimestampType() if m[1] else T.TimestampNTZType()
    base = re.sub(r"\s*\(.*\)|\[.*\]", "", t).strip()
    own = SYSTEMS[system]
    if base in own or base in NAMES:
        return own.get(base, NAMES.get(base))
    warnings.warn(f"type {text!r} isn't known; taken as string", stacklevel=2)
    return T.StringType()


def compatible(written: T.StructType, target: T.StructType) -> list[str]:
    """What keeps rows of one schema out of a table of another: names as sets, and types up to time zones and strings for timestamps."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (written, target))
    out = [f"missing {n}" for n in sorted(b.keys() - a.keys())] + [f"unknown {n}" for n in sorted(a.keys() - b.keys())]
    times = (T.TimestampType, T.TimestampNTZType)
    for n in sorted(a.keys() & b.keys()):
        x, y = a[n], b[n]
        loose = isinstance(x, times) and isinstance(y, (*times, T.StringType)) or isinstance(x, T.StringType) and isinstance(y, times) or {x.simpleString(), y.simpleString()} == {"bigint", "decimal(38,0)"}
        if x != y and not loose:
            out.append(f"{n}: {x.simpleString()} for {y.simpleString()}")
    return out
