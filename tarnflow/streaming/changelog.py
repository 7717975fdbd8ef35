"""A keyed table kept as a log of changes with deletes, merged into sorted base files when the log outgrows them.

Everything is Parquet under one folder: ``log/batch=N`` holds the changes of batch N, ``base/version=N`` all keys as they
stood after it, ``versions/version=N`` one row that says which of them a reader of version N takes. That row is written last,
so a version is there whole or not at all; a batch that runs again after a failure replaces what it wrote before. Nothing is
changed in place: a reader that holds a version goes on reading it, whatever is written meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELETED = "deleted"
_VERSION = "version long, base long, base_rows long, batches array<long>, log_rows long"


@dataclass(frozen=True)
class Version:
    """What a version is made of: a base (or None) and the batches of the log behind it."""

    version: int
    base: int | None
    base_rows: int
    batches: tuple[int, ...]
    log_rows: int


@dataclass(frozen=True)
class ChangeLog:
    """Rows by ``key``, of which the one with the greatest ``order`` stands (equal: that of the later batch).

    Changes have the table's columns and a flag ``deleted``; a deleted key's other columns are not looked at. A deletion is kept
    like a row, so that an older change that comes after it stays without effect. The log is merged into a new base when it has more than
    ``share`` times the base's rows. Rows without a key are passed over.
    """

    spark: SparkSession
    path: str
    key: str
    order: str
    share: float = 0.25

    def versions(self) -> list[Version]:
        """All versions, the oldest first: one small row each."""
        try:
            rows = self.spark.read.schema(_VERSION).json(f"{self.path}/versions").collect()
        except AnalysisException:  # nothing has been written
            return []
        return sorted((Version(r["version"], r["base"], r["base_rows"], tuple(r["batches"]), r["log_rows"]) for r in rows), key=lambda v: v.version)

    def _latest(self, changes: DataFrame) -> DataFrame:
        """One row a key, by a pre-aggregated maximum: a key with very many changes is no burden to one task."""
        columns = [c for c in changes.columns if c != "__batch"]
        newest = F.max_by(F.struct(*columns), F.struct(self.order, "__batch")).alias("x")
        return changes.filter(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(newest).select("x.*")

    def _all(self, v: Version) -> DataFrame:
        parts = [(f"log/batch={b}", b) for b in v.batches] + ([(f"base/version={v.base}", -1)] if v.base is not None else [])
        out = None
        for folder, batch in parts:
            part = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("__batch", F.lit(batch))
            out = part if out is None else out.unionByName(part)
        return self._latest(out)

    def apply(self, changes: DataFrame, number: int) -> Version:
        """Write a batch of changes as version ``number``, and merge the log if it has outgrown the base."""
        known = [v for v in self.versions() if v.version < number]
        last = known[-1] if known else Version(-1, None, 0, (), 0)
        folder = f"{self.path}/log/batch={number}"
        self._latest(changes.withColumn("__batch", F.lit(number))).write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder).count()
        new = Version(number, last.base, last.base_rows, (*last.batches, number) if rows else last.batches, last.log_rows + rows)
        if new.batches and new.log_rows > self.share * new.base_rows:
            folder = f"{self.path}/base/version={number}"
            merged = self._all(new)
            merged.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(folder)
            new = Version(number, number, self.spark.read.parquet(folder).count(), (), 0)
        row = [(new.version, new.base, new.base_rows, list(new.batches), new.log_rows)]
        self.spark.createDataFrame(row, _VERSION).coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/commit={number}")
        return new

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version (default: the newest), without ``deleted``."""
        found = [v for v in self.versions() if version is None or v.version == version]
        if not found:
            raise ValueError(f"{self.path} has no version" + ("" if version is None else f" {version}"))
        v = found[-1]
        if not v.batches and v.base is None:
            rows = self.spark.read.parquet(f"{self.path}/log/batch={v.version}")
        elif not v.batches:
            rows = self.spark.read.parquet(f"{self.path}/base/version={v.base}")  # a key stands there once
        else:
            rows = self._all(v)
        return rows.filter(~F.col(DELETED)).drop(DELETED)

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The live rows of some keys (a column named as ``key``): sorted base files are read where their keys lie."""
        return self.read(version).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def delete(self, keys: DataFrame, number: int | None = None) -> Version:
        """Delete keys (columns ``key`` and ``order``) as a batch of its own."""
        found = self.versions()
        number = number if number is not None else (found[-1].version + 1 if found else 0)
        schema = self.read().schema if found else keys.schema
        columns = [F.col(f.name) if f.name in (self.key, self.order) else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return self.apply(keys.select(*columns, F.lit(True).alias(DELETED)), number)

    def superseded(self, keep: int = 1) -> list[str]:
        """Folders that none of the last ``keep`` versions reads, for whoever clears them when no older reader is left."""
        found = self.versions()
        used = {x for v in found[-keep:] for x in (f"base/version={v.base}", *(f"log/batch={b}" for b in v.batches), f"log/batch={v.version}")}
        every = {x for v in found for x in (f"base/version={v.base}", *(f"log/batch={b}" for b in v.batches), f"log/batch={v.version}")} - {"base/version=None"}
        return sorted(f"{self.path}/{x}" for x in every - used)

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Apply what a stream's source has now, batch after batch; a restart goes on from the checkpoint."""
        query = changes.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number) and None).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
