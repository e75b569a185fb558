"""Tables as versioned Parquet snapshots with changes on top; a commit is one file, so readers never see half of it.

A commit writes its data under a new number and then a manifest of that number, which lists the data of every table. The
state is the highest manifest that is complete: a crash at any moment leaves the one before, and what it wrote is never read.
Manifests are created, never replaced, so of two writers of the same number one fails. Partition columns prune scans; sorting
inside files lets row groups be skipped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFESTS = "_commits"
#: Changes on top of a snapshot after which `append` writes a whole one again.
MOST_CHANGES = 20


class Store:
    """A folder of tables, each `name/v000001`, ..., and of manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/{_MANIFESTS}")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _state(self) -> dict:
        """The highest manifest that was written to its end."""
        for n in self._numbers():
            stream = self._fs.open(self._path(f"{self.root}/{_MANIFESTS}/{n:08d}"))
            try:
                return json.loads(stream.readUTF())
            except Exception:  # noqa: BLE001 (cut short: the writer crashed)
                continue
            finally:
                stream.close()
        return {"tables": {}, "marks": {}}

    def version(self, name: str) -> int:
        """Current version of a table; 0 if there is none."""
        return max(self._state()["tables"].get(name, {"parts": [0]})["parts"])

    def mark(self, name: str) -> int | None:
        """What a commit said of itself, such as the last batch of a stream."""
        return self._state()["marks"].get(name)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or one snapshot or set of changes by its number."""
        if version:
            return self.spark.read.parquet(f"{self.root}/{name}/v{version:06d}")
        table = self._state()["tables"].get(name)
        if table is None:
            raise LookupError(f"no table {name}")
        parts = [self.read(name, v) for v in table["parts"]]
        if len(parts) == 1:
            return parts[0]
        cols = parts[0].columns
        rows = [p.select(*cols, F.lit(v).alias("__version")) for p, v in zip(parts, table["parts"], strict=True)]
        both = rows[0]
        for r in rows[1:]:
            both = both.unionByName(r)
        return both.groupBy(F.col(table["key"]).alias("__key")).agg(F.max_by(F.struct(*cols), "__version").alias("__row")).select("__row.*")

    def _write(self, tables: dict[str, dict], marks: dict[str, int] | None, n: int, state: dict) -> dict[str, int]:
        new = {"tables": state["tables"] | tables, "marks": state["marks"] | (marks or {})}
        stream = self._fs.create(self._path(f"{self.root}/{_MANIFESTS}/{n:08d}"), False)  # fails if another writer was first
        stream.writeUTF(json.dumps(new))
        stream.close()
        return {name: n for name in tables}

    def commit(self, changes: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, sort_by: dict[str, list[str]] | None = None, marks: dict[str, int] | None = None) -> dict[str, int]:
        """Writes all changed tables whole, then the manifest that makes them current together."""
        state, n = self._state(), max([0, *self._numbers()]) + 1
        for name, df in changes.items():
            keys = (sort_by or {}).get(name)
            parts = (partition_by or {}).get(name, [])
            if keys or parts:
                df = df.repartition(*parts).sortWithinPartitions(*parts, *(keys or [])) if parts else df.sortWithinPartitions(*keys)
            df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}/v{n:06d}")
        return self._write({name: {"parts": [n]} for name in changes}, marks, n, state)

    def append(self, name: str, rows: DataFrame, key: str, marks: dict[str, int] | None = None) -> dict[str, int]:
        """Writes new and changed rows only; of rows with one key the last written holds. Whole again after MOST_CHANGES."""
        state, n = self._state(), max([0, *self._numbers()]) + 1
        before = state["tables"].get(name, {"parts": []})["parts"]
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n:06d}")
        done = self._write({name: {"parts": [*before, n], "key": key}}, marks, n, state)
        return self.commit({name: self.read(name)}) if len(before) >= MOST_CHANGES else done
