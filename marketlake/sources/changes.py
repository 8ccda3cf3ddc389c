"""A table of one row per key, kept as a base and the changes after it.

Every write adds a folder with the changed rows only, under a number that its writer gives: a micro-batch that
is repeated replaces its own folder. Readers merge the newest base and the changes after it. After every
``compact_every`` writes the table is written out as a new base, and the folders before the last base
are removed; those between are left to readers that have begun. A folder counts once its job has ended.

A table has one writer. Several producers write tables of their own, merged when read (``CacheTable``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.sources.files import complete_folders, folders, remove_folder

NUMBER = "_write"


class ChangeTable:
    """``order`` are the columns that tell which of two rows of a key is newer, before the number of their writes.

    With ``by_field`` a null does not hide an older value: every field comes from the newest row that has it.
    Else the newest row counts as a whole, and ``gone``, a boolean field, marks keys that are no more. An update that is older
    than a compacted row of its key only fills that row's gaps.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], order: list[str] | None = None,
        *, by_field: bool = True, gone: str | None = None, compact_every: int = 16,
    ):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.order, self.by_field, self.gone, self.compact_every = [*(order or []), NUMBER], by_field, gone, compact_every

    def write(self, rows: DataFrame, number: int | None = None) -> int:
        """Adds the changed rows, at most one per key, and returns the number of the write (the next one if not given)."""
        if number is None:
            newest = self.newest()
            number = 0 if newest is None else newest + 1
        self._save(rows.withColumn(NUMBER, F.lit(number).cast("long")), "change", number)
        if (number + 1) % self.compact_every == 0:
            self.compact()
        return number

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as of the newest write, or of write ``upto`` while its folders are there."""
        return self._rows(upto).drop(NUMBER)

    def newest(self) -> int | None:
        return max((n for _, n in self._parts()), default=None)

    def compact(self) -> None:
        """Writes the table as a new base and removes what lies before the base until now."""
        parts = self._parts()
        base = max((n for kind, n in parts if kind == "base"), default=-1)
        newest = max((n for _, n in parts), default=-1)
        if newest > base:
            self._save(self._rows(newest), "base", newest)
            for name in folders(self.spark, self.path):
                kind, _, number = name.partition("-")
                if int(number) < base or (kind == "change" and int(number) == base):
                    remove_folder(self.spark, f"{self.path}/{name}")

    def _parts(self, upto: int | None = None) -> list[tuple[str, int]]:
        found = [(kind, int(n)) for kind, _, n in (x.partition("-") for x in complete_folders(self.spark, self.path))]
        return [(kind, n) for kind, n in found if upto is None or n <= upto]

    def _rows(self, upto: int | None) -> DataFrame:
        parts = self._parts(upto)
        base = max((n for kind, n in parts if kind == "base"), default=-1)
        names = [f"{k}-{n:012d}" for k, n in parts if (k, n) == ("base", base) or (k == "change" and n > base)]
        stored = T.StructType([*self.schema.fields, T.StructField(NUMBER, T.LongType())])
        if not names:
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(*[f"{self.path}/{n}" for n in names])
        if len(names) > 1:  # a base alone is read as it is, and Spark knows its size
            rows = self._merged(rows)
        return rows.where(f"not {self.gone}") if self.gone else rows

    def _merged(self, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c not in self.key]
        rank = F.struct(*self.order)
        if self.by_field:
            newest = [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields]
            return rows.groupBy(*self.key).agg(*newest)
        whole = F.max_by(F.struct(*fields), rank).alias("_row")
        return rows.groupBy(*self.key).agg(whole).select(*self.key, "_row.*")

    def _save(self, rows: DataFrame, kind: str, number: int) -> None:
        names = [*self.schema.fieldNames(), NUMBER]
        have = [F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names]
        rows.select(*have).write.mode("overwrite").parquet(f"{self.path}/{kind}-{number:012d}")
