"""What the operators share: column picking, the shared work folder, Arrow batches, file access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the operators' contracts: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"

READ_ROWS = 64

_own_dir: str | None = None


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _c0, _c1, ..., so that names that clash (also by case) do no harm."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> int:
    """The index of a column: the exact name first, else the first that differs by case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    for i, other in enumerate(names):
        if other.lower() == name.lower():
            return i
    raise ValueError(f"no column {name!r} among {names}")


def pick(df: DataFrame, **columns: str | tuple[str, str]) -> DataFrame:
    """Select alias=name or alias=(name, type); other columns of df are ignored, whatever their names."""
    flat = numbered(df)
    out = []
    for alias, what in columns.items():
        name, kind = what if isinstance(what, tuple) else (what, None)
        c = F.col(f"_c{place(df, name)}")
        out.append((c.cast(kind) if kind else c).alias(alias))
    return flat.select(*out)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text is the empty text."""
    flat = pick(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    return flat.withColumn("text", F.coalesce("text", F.lit("")))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch, and one batch of the Parquet reader, holds; texts can be long.

    The reader has no bound in bytes: its 4096 rows of 200 KB are 0.8 GB in one array, twice that while it grows.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001 - a Spark without this setting
        pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared folder (spark.checkpoint.dir); one of our own only where that is unset."""
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="quern-")
        base = f"file://{_own_dir}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; its shared folder goes with the cluster's own cleaning
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        shared_dir(spark, "unused")
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a path or URI, as executors need it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
