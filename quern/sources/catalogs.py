"""Catalogs: named places of tables that steps read from and write to.

A catalog is a mapping with a type and options:

    filesystem  path (any that Spark reaches: local, hdfs, s3a, gs, ...), format
    spark       prefix: a database or catalog.schema before table names; Hive, Glue, Unity and the like come as Spark's own catalogs
    jdbc        url, driver, user, password and Spark's other JDBC options, for all databases with a driver
    memory      nothing: tables live in the session

Reads take options: for jdbc, partition_column, lower_bound, upper_bound and num_partitions make a partitioned read; for spark tables of
formats that have them, versionAsOf or timestampAsOf (the version wins) read an older state, and readChangeFeed its changes; filter, a
key=value mapping, prunes partitions.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.write import Files, Jdbc, Memory, Table, Target, _fs, read_jdbc
from quern.sources.files import EXTENSIONS, detect, read, resolve, table_path

TYPES = ("filesystem", "spark", "jdbc", "memory")
#: Our names of Spark's options for a partitioned JDBC read.
PARTITIONED = {"partition_column": "partitionColumn", "lower_bound": "lowerBound", "upper_bound": "upperBound", "num_partitions": "numPartitions"}


class CatalogError(Exception):
    pass


@dataclass
class Reference:
    """What a name in a query stands for: kind step or table."""

    kind: str
    name: str
    catalog: str | None = None
    schema: str | None = None


def jdbc_options(options: dict[str, Any]) -> dict[str, str]:
    """Spark's options of a read; a partitioned one needs all four of its settings."""
    own = {k: str(v) for k, v in options.items() if k not in PARTITIONED and k != "type"}
    given = [k for k in PARTITIONED if options.get(k) is not None]
    if given and len(given) < len(PARTITIONED):
        raise CatalogError(f"a partitioned read also needs {', '.join(sorted(set(PARTITIONED) - set(given)))}")
    return own | {PARTITIONED[k]: str(options[k]) for k in given}


@dataclass
class Catalogs:
    spark: SparkSession
    specs: dict[str, dict[str, Any]] = field(default_factory=dict)
    default: str | None = None

    def __post_init__(self):
        self.stores: dict[str, dict[str, DataFrame]] = {}
        for name, spec in self.specs.items():
            if spec.get("type") not in TYPES:
                raise CatalogError(f"{name}: unknown type {spec.get('type')!r}")

    def spec(self, name: str | None) -> dict[str, Any]:
        name = name or self.default
        if name not in self.specs:
            raise CatalogError(f"no catalog {name!r}")
        return self.specs[name]

    def _path(self, spec: dict, table: str) -> str:
        """The folder or file of a table, also where it isn't yet."""
        try:
            return table_path(spec["path"].rstrip("/"), table, self.spark)
        except FileNotFoundError:
            return f"{spec['path'].rstrip('/')}/{table}"

    def _named(self, spec: dict, table: str) -> str:
        return f"{spec['prefix']}.{table}" if spec.get("prefix") else table

    def read(self, catalog: str | None, table: str, format: str | None = None, **options: Any) -> DataFrame:
        spec, where = self.spec(catalog), options.pop("filter", None)
        kind = spec["type"]
        if kind == "filesystem":
            path = table_path(spec["path"].rstrip("/"), table, self.spark)
            df = read(self.spark, path, resolve([format, spec.get("format")], detect(self.spark, path)), **options)
        elif kind == "spark":
            if "versionAsOf" in options:
                options.pop("timestampAsOf", None)
            df = self.spark.read.options(**options).table(self._named(spec, table))
        elif kind == "jdbc":
            df = read_jdbc(self.spark, jdbc_options({**spec, **options}), table)
        else:
            store = self.stores.setdefault(catalog or self.default, {})
            if table not in store:
                raise CatalogError(f"no table {table!r} in memory")
            df = store[table]
        for column, value in (where or {}).items():
            df = df.filter(F.col(column) == F.lit(value))
        return df

    def target(self, catalog: str | None, table: str, format: str | None = None, options: dict[str, str] | None = None, partition_by: list[str] | None = None) -> Target:
        spec = self.spec(catalog)
        kind = spec["type"]
        if kind == "filesystem":
            return Files(self.spark, self._path(spec, table), resolve([format, spec.get("format")], "parquet", "sink"), dict(options or {}), list(partition_by or []))
        if kind == "spark":
            return Table(self.spark, self._named(spec, table), format or spec.get("format"), list(partition_by or []))
        if kind == "jdbc":
            return Jdbc(self.spark, table, jdbc_options({k: v for k, v in {**spec, **(options or {})}.items() if k not in PARTITIONED}))
        return Memory(self.stores.setdefault(catalog or self.default, {}), table)

    # ---- looking around ----

    def tables(self, catalog: str) -> list[str]:
        spec = self.spec(catalog)
        kind = spec["type"]
        if kind == "filesystem":
            fs, at = _fs(self.spark, spec["path"])
            names = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at(spec["path"]))] if fs.exists(at(spec["path"])) else []
            shown = [(n, d) for n, d in names if not n.startswith(("_", "."))]
            return sorted({n if d and n.rpartition(".")[2].lower() not in EXTENSIONS else n.rpartition(".")[0] for n, d in shown if d or n.rpartition(".")[2].lower() in EXTENSIONS})
        if kind == "spark":
            return sorted(t.name for t in (self.spark.catalog.listTables(spec["prefix"]) if spec.get("prefix") else self.spark.catalog.listTables()) if not t.isTemporary)
        if kind == "memory":
            return sorted(self.stores.get(catalog, {}))
        c, out = self.target(catalog, "x")._connection(), []
        try:
            found = c.getMetaData().getTables(None, spec.get("schema"), "%", None)
            while found.next():
                if found.getString("TABLE_TYPE") in ("TABLE", "VIEW", "BASE TABLE"):
                    out.append(found.getString("TABLE_NAME"))
        finally:
            c.close()
        return sorted(out)

    def columns(self, catalog: str, table: str) -> list[tuple[str, str]]:
        """Names and types; data isn't read (but for formats whose types are inferred)."""
        spec = self.spec(catalog)
        df = self.spark.read.format("jdbc").options(**jdbc_options(spec), dbtable=table).load() if spec["type"] == "jdbc" else self.read(catalog, table)
        return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]

    def metadata(self, catalog: str, table: str) -> dict[str, Any]:
        """Columns and, of files, path, format, bytes, number of files and time of the last change."""
        spec, out = self.spec(catalog), {"columns": self.columns(catalog, table)}
        if spec["type"] != "filesystem":
            return out
        path = table_path(spec["path"].rstrip("/"), table, self.spark)
        fs, at = _fs(self.spark, path)
        s = fs.getContentSummary(at(path))
        changed, files = fs.getFileStatus(at(path)).getModificationTime(), fs.listFiles(at(path), True)
        while files.hasNext():
            changed = max(changed, files.next().getModificationTime())
        return out | {"path": path, "format": detect(self.spark, path), "bytes": s.getLength(), "files": s.getFileCount(), "changed": changed}

    def fingerprint(self, catalog: str, table: str) -> str:
        """Another one if the table's columns or, of files, its contents have changed."""
        return hashlib.sha256(json.dumps(self.metadata(catalog, table), sort_keys=True).encode()).hexdigest()[:16]

    def test(self, catalog: str) -> str | None:
        """Why the catalog can't be used, or None."""
        try:
            spec = self.spec(catalog)
            if spec["type"] == "filesystem":
                fs, at = _fs(self.spark, spec["path"])
                return None if fs.exists(at(spec["path"])) else f"no folder {spec['path']}"
            self.tables(catalog)
            return None
        except Exception as e:  # noqa: BLE001 - the reason is the answer
            return str(e).splitlines()[0]

    def search(self, text: str, cache: Cache | None = None, most: int = 20) -> list[tuple[float, str, str]]:
        """(score, catalog, table) of tables whose names fit, best first."""
        found = []
        for c in self.specs:
            names = (cache.get(f"tables:{c}") if cache else None) or self.tables(c)
            if cache:
                cache.put(f"tables:{c}", names)
            found += [(s, c, t) for t in names if (s := fits(text, f"{c}.{t}")) is not None]
        return sorted(found)[:most]

    def resolve(self, name: str, steps: set[str] | dict[str, Any]) -> Reference:
        """One part: a step, a table of the default catalog, else the table that fits best. Two: catalog.table, or schema.table in the default
        one. Three: catalog.schema.table; of more parts the last three."""
        parts = name.split(".")
        if len(parts) == 1:
            if name in steps:
                return Reference("step", name)
            if self.default is None and (hits := self.search(name)):
                return Reference("table", hits[0][2], hits[0][1])
            return Reference("table", name, self.default)
        if len(parts) == 2:
            return Reference("table", parts[1], parts[0]) if parts[0] in self.specs else Reference("table", parts[1], self.default, parts[0])
        return Reference("table", parts[-1], parts[-3], parts[-2])


def fits(text: str, name: str) -> float | None:
    """How well letters of text, in their order, stand in name (case aside): lower is better; None: they don't.

    The best of all placements: each gap costs its length, up to four, a start inside a word one, and the name's length a little.
    """
    text, low = text.lower(), name.lower()
    best: dict[int, float] = {-1: 0.0}
    for ch in text:
        at: dict[int, float] = {}
        for last, cost in best.items():
            i = low.find(ch, last + 1)
            while i >= 0:
                gap = i - last - 1
                inside = i > 0 and low[i - 1].isalnum()
                c = cost + (min(gap, 4) + inside if gap or last < 0 else 0)
                if c < at.get(i, float("inf")):
                    at[i] = c
                i = low.find(ch, i + 1)
        best = at
    return min(best.values()) + len(low) / 100 if best else None


class Cache:
    """What was found out about catalogs, in a JSON file: entries hold for some seconds, and the least recently used go when it is full."""

    def __init__(self, path: str | Path, seconds: float = 300, most_bytes: int = 50 << 20, clock=time.time):
        self.path, self.seconds, self.most, self.clock = Path(path), seconds, most_bytes, clock
        try:
            self.entries: dict[str, dict[str, Any]] = json.loads(self.path.read_text())
        except (OSError, ValueError):
            self.entries = {}

    def get(self, key: str) -> Any:
        e = self.entries.get(key)
        if e is None or self.clock() - e["at"] > self.seconds:
            return None
        self.entries[key] = self.entries.pop(key)  # the most recently used are last
        return e["value"]

    def put(self, key: str, value: Any) -> None:
        self.entries.pop(key, None)
        self.entries[key] = {"at": self.clock(), "value": value}
        data = json.dumps(self.entries)
        while len(data) > self.most and self.entries:
            del self.entries[next(iter(self.entries))]
            data = json.dumps(self.entries)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_name(self.path.name + ".new")
        new.write_text(data)
        new.replace(self.path)
