"""Stored snapshots: Parquet tables under versioned folders, swapped as a whole.

A commit writes all tables of a new snapshot and then one small marker; readers take
the newest marked snapshot, so a run that dies half-way changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import VERSION


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        """Numbers of whole snapshots of this layout version, oldest first."""
        p, fs = self._fs(f"{self.root}/v{VERSION}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            mark = self._fs(f"{s.getPath()}/_COMMITTED")[0]
            if fs.exists(mark):
                found.append(int(s.getPath().getName()))
        return sorted(found)

    def path(self, table: str, snapshot: int) -> str:
        return f"{self.root}/v{VERSION}/{snapshot}/{table}"

    def read(self, table: str, snapshot: int | None = None) -> DataFrame | None:
        found = self.snapshots()
        if not found:
            return None
        return self.spark.read.parquet(self.path(table, found[-1] if snapshot is None else snapshot))

    def claim(self) -> int:
        """The number of a new snapshot, which no other writer has or gets."""
        number = (self.snapshots() or [0])[-1] + 1
        while True:
            p, fs = self._fs(f"{self.root}/v{VERSION}/{number}/_CLAIMED")
            try:
                fs.create(p, False).close()
                return number
            except Exception:
                if not fs.exists(p):
                    raise
                number += 1

    def commit(self, tables, sort: dict[str, list[str]] | None = None, number: int | None = None, more=None) -> int:
        """Write a snapshot of all tables; its marker is written last.

        Tables named in ``sort`` are laid out by those columns for pruning. ``more`` is
        called with the number before the marker, for tables made from the stored ones.
        """
        number = self.claim() if number is None else number
        for name, df in tables.items():
            keys = (sort or {}).get(name)
            if keys:
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name, number))
        if more is not None:
            more(number)
        p, fs = self._fs(f"{self.root}/v{VERSION}/{number}/_COMMITTED")
        fs.create(p, True).close()
        return number

    def drop(self, table: str, number: int) -> None:
        p, fs = self._fs(self.path(table, number))
        fs.delete(p, True)

    def has(self, table: str, number: int) -> bool:
        p, fs = self._fs(self.path(table, number))
        return fs.exists(p)

    def clear(self) -> None:
        p, fs = self._fs(self.root)
        fs.delete(p, True)

    def size(self) -> int:
        p, fs = self._fs(self.root)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest snapshots; only when no reader uses the older ones."""
        for n in self.snapshots()[:-keep]:
            p, fs = self._fs(f"{self.root}/v{VERSION}/{n}")
            fs.delete(p, True)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` whose key ``new`` doesn't have, and the last row of each key of ``new`` (by version, if it has one)."""
    if "version" in new.columns:
        w = Window.partitionBy(key).orderBy(F.desc("version"))
        new = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "version")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The one row with the given column values, for point reads; many keys are better joined (see ``pick``)."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df.limit(1)


def pick(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("parent_file_id").agg(F.count(F.lit(1)).alias("chunks"))
