"""Files as lazy DataFrames, with the format found from the path where it isn't given."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from quern.operators.write import _fs

# Extensions of formats, in the order that settles ties.
EXTENSIONS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "arrow": "ipc", "ipc": "ipc", "feather": "ipc", "orc": "orc"}
FORMATS = ("parquet", "csv", "json", "ipc", "orc", "delta", "text", "binaryFile")
SUPPORT = {("filesystem", "source"): {"parquet", "csv", "json", "ipc", "orc", "text", "binaryFile"}, ("filesystem", "sink"): {"parquet", "csv", "json", "orc"}}


def detect(spark: SparkSession, path: str) -> str:
    """By extension; else, of a folder, Delta's log or the commonest extension in it; else parquet."""
    ext = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return "parquet"
    if fs.exists(at(f"{path}/_delta_log")):
        return "delta"
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    found = Counter(EXTENSIONS[e] for n in names if not n.startswith(("_", ".")) and (e := n.rpartition(".")[2].lower()) in EXTENSIONS)
    return min(found, key=lambda f: (-found[f], FORMATS.index(f))) if found else "parquet"


def resolve(formats: list[str | None], path_format: str, role: str = "source", kind: str = "filesystem") -> str:
    """The first given format that this kind of catalog can take in this role; else the path's; else parquet."""
    ok = SUPPORT[kind, role]
    for f in [*formats, path_format]:
        if f in ok:
            return f
    return "parquet"


def read(spark: SparkSession, path: str, format: str | None = None, **options: str) -> DataFrame:
    """A file or folder; csv has a header and inferred types unless options say otherwise, tsv is separated by tabs."""
    fmt = format or detect(spark, path)
    if fmt == "ipc":
        from quern.sources.ipc import ArrowFiles

        spark.dataSource.register(ArrowFiles)
        return spark.read.format("arrow_ipc").options(**options).load(path)
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "true", "sep": "\t" if path.rstrip("/").endswith(".tsv") else ","} | options
    return spark.read.format(fmt).options(**options).load(path)


def table_path(base: str, table: str, spark: SparkSession) -> str:
    """base/table, or the only file base/table.* whose extension is a format's."""
    fs, at = _fs(spark, base)
    if fs.exists(at(f"{base}/{table}")):
        return f"{base}/{table}"
    hits = sorted(s.getPath().getName() for s in (fs.listStatus(at(base)) if fs.exists(at(base)) else []) if s.getPath().getName().rpartition(".")[0] == table and s.getPath().getName().rpartition(".")[2].lower() in EXTENSIONS)
    if not hits:
        raise FileNotFoundError(f"{base} has no table {table}")
    return f"{base}/{hits[0]}"
