"""Keyed tables that streaming batches write: a merged base, the batches since, and the step that merges them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the completely written folders ``name=n`` in ``path``, ascending."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith(f"{name}=")]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=", 1)[1]) for p in found if files.exists(mark(p, "_SUCCESS")))


def newest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row of the highest ``version`` of each key; nulls are the lowest.

    Meant for rows of which few share a key: they are dealt by key as they are and sorted once, not before the shuffle too.
    Only the columns that a reader asks for are shuffled.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in version])
    return rows.repartition(*keys).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class BatchTable:
    """Rows by key under ``path``; of rows with one key that of the highest (``version``, batch number) is the current one.

    A batch is written under its number and replaces what an earlier try of the same batch left, so a batch that is run
    again changes nothing. After every ``every`` batches all rows are merged into a new base, and readers need the
    newest base and the batches after it only, however many there were. The base before the newest and the
    batches after that one stay, for readers that began earlier and for a batch that is run again.
    """

    path: str
    schema: T.StructType
    keys: Sequence[str]
    version: Sequence[str] = ()
    every: int = 16

    def write(self, rows: DataFrame, epoch: int) -> None:
        names = [f.name for f in self.schema]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/batches/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            self.merge(rows.sparkSession, epoch)

    def merge(self, spark: SparkSession, upto: int) -> None:
        """Writes the base of all batches up to ``upto``, then drops what lies before the base that it follows.

        A base that an earlier try has written is replaced, so it is not read.
        """
        rows = self.stored(spark, before=upto).unionByName(self.batch(spark, upto))
        newest(rows, self.keys, [*self.version, "epoch"]).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        older = [n for n in numbered(spark, f"{self.path}/base", "upto") if n < upto]
        if older:
            for n in older[:-1]:
                remove_folder(spark, f"{self.path}/base/upto={n}")
            for n in numbered(spark, f"{self.path}/batches", "epoch"):
                if n <= older[-1]:
                    remove_folder(spark, f"{self.path}/batches/epoch={n}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The current rows, or those that were current before batch ``before``."""
        return newest(self.stored(spark, before), self.keys, [*self.version, "epoch"]).drop("epoch")

    def sources(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """The folders that a reader needs."""
        bases = [n for n in numbered(spark, f"{self.path}/base", "upto") if before is None or n < before]
        base = bases[-1] if bases else -1
        after = [n for n in numbered(spark, f"{self.path}/batches", "epoch") if n > base and (before is None or n < before)]
        return [f"{self.path}/base/upto={base}"] * (base >= 0) + [f"{self.path}/batches/epoch={n}" for n in after]

    def batch(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The rows of one batch, as they were written, with its number."""
        return self._rows(spark, [f"{self.path}/batches/epoch={epoch}"])

    def stored(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What a reader needs, with the batch numbers: all current rows, and those of their keys that newer ones replaced since."""
        return self._rows(spark, self.sources(spark, before))

    def _rows(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        with_epoch = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])
        bases, batches = [f for f in folders if "/base/upto=" in f], [f for f in folders if "/batches/epoch=" in f]
        parts = [spark.read.schema(with_epoch).parquet(*bases)] if bases else []
        if batches:
            parts.append(spark.read.schema(with_epoch).option("basePath", f"{self.path}/batches").parquet(*batches))
        # The filter tells the optimizer that nothing is there.
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], with_epoch).where("false")
