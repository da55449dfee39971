"""Named tables: files in any format Spark reads, catalog tables, JDBC, or frames."""

from __future__ import annotations

import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnknownName


class Tables:
    """Tables by name. A source is a DataFrame, a path, or a dict of format, path and options."""

    def __init__(self, spark: SparkSession, sources: dict[str, Any] | str | None = None):
        self.spark = spark
        self.folder = sources if isinstance(sources, str) else None
        self.sources: dict[str, Any] = {} if isinstance(sources, str) or sources is None else dict(sources)
        self.read_before: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        try:
            self.read(name)
            return True
        except UnknownName:
            return False

    def read(self, name: str) -> DataFrame:
        """Lazy; the schema is read once."""
        if name not in self.read_before:
            self.read_before[name] = self._read(name)
        return self.read_before[name]

    def _read(self, name: str) -> DataFrame:
        source = self.sources.get(name, self.sources.get(name.rsplit(".", 1)[-1]))
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, dict):
            source = {k: _environment(v) for k, v in source.items()}
            reader = self.spark.read.format(source.get("format", "parquet")).options(**source.get("options", {}))
            return reader.load(source["path"]) if "path" in source else reader.load()
        if isinstance(source, str):
            return self.spark.read.format(_format(source)).options(**_options(source)).load(_environment(source))
        if self.folder:
            try:
                return self.spark.read.parquet(f"{self.folder}/{name.rsplit('.', 1)[-1]}.parquet")
            except Exception as e:
                raise UnknownName(f"no table {name!r} in {self.folder}") from e
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise UnknownName(f"no table {name!r}")

    def names(self) -> list[str]:
        if self.sources:
            return sorted(self.sources)
        if self.folder:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
            return sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))
        return sorted(t.name for t in self.spark.catalog.listTables())


def _environment(value):
    """${NAME} by the environment's value."""
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise UnknownName(f"environment variable {m[1]} isn't set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", put, value)


def _format(path: str) -> str:
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return {"csv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}.get(end, "parquet")


def _options(path: str) -> dict[str, str]:
    return {"header": "true", "inferSchema": "true"} if _format(path) == "csv" else {}
