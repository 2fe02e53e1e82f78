"""Batch high-water marks: what of a source was read so far, in a small JSON file on any file system that Spark reaches."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.write import _fs


class Marks:
    """Marks by name. The file is written beside the old one, which it then replaces, so a reader never sees half of one.

    One writer at a time: two that save at once may lose one's marks.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def all(self) -> dict[str, dict[str, Any]]:
        fs, at = _fs(self.spark, self.path)
        for path in (self.path, f"{self.path}.new"):  # a save that broke off between its two steps has left only the new one
            if fs.exists(at(path)):
                f = fs.open(at(path))
                try:
                    return json.loads(bytes(f.readAllBytes()).decode())
                except ValueError:
                    if path == self.path:
                        raise
                finally:
                    f.close()
        return {}

    def get(self, name: str) -> Any:
        return self.all().get(name, {}).get("value")

    def set(self, name: str, value: Any, kind: str = "string") -> None:
        self._save(self.all() | {name: {"value": str(value), "type": kind}})

    def reset(self, name: str) -> None:
        self._save({k: v for k, v in self.all().items() if k != name})

    def _save(self, marks: dict) -> None:
        fs, at = _fs(self.spark, self.path)
        new = at(f"{self.path}.new")
        if (parent := at(self.path).getParent()) is not None:
            fs.mkdirs(parent)
        f = fs.create(new, True)
        f.write(bytearray(json.dumps(marks, indent=1, sort_keys=True).encode()))
        f.close()
        if fs.exists(at(self.path)):
            fs.delete(at(self.path), False)
        fs.rename(new, at(self.path))

    def unread(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Rows past the mark (all, without one); the filter reaches the scan."""
        mark = self.all().get(name)
        return df if mark is None else df.filter(F.col(column) > F.lit(mark["value"]).cast(mark["type"]))

    def batch(self, df: DataFrame, name: str, column: str) -> tuple[DataFrame, tuple[str, str] | None]:
        """Rows past the mark and up to the greatest value there is now, and that value with its type: the next mark.

        Rows that come while the batch is worked on are in the next one. None: nothing is past the mark.
        """
        rest = self.unread(df, name, column)
        high = rest.agg(F.max(column).alias("m")).first().m
        kind = df.schema[column].dataType.simpleString()
        return (rest, None) if high is None else (rest.filter(F.col(column) <= F.lit(str(high)).cast(kind)), (str(high), kind))

    def advance(self, df: DataFrame, name: str, column: str) -> Any:
        """Set the mark to df's greatest value, once what was read is safely written; it never goes back."""
        value = df.agg(F.max(column).alias("m")).first().m
        if value is not None:
            self.set(name, value, df.schema[column].dataType.simpleString())
        return value
