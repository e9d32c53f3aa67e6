"""A keyed table that a stream writes: one delta for each batch, merged when read, so that a batch written twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import shared


class Upserts:
    """Rows by key, the one of the greatest order columns counting; of equal ones that of the later batch.

    `path/delta-N` has batch N, reduced to a row for each key; writing it again replaces it. `path/base-N` has all batches up to N, made by `compact`; only
    folders that were written whole count. A reader merges the newest base and the deltas after it, so its work follows the table and what came since."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch. A batch that a base has already is left alone: it was written before."""
        if batch > self._base():
            self._reduced(rows.select(*self.schema.names).withColumn("_batch", F.lit(batch))).write.mode("overwrite").parquet(f"{self.path}/delta-{batch}")

    def read(self) -> DataFrame:
        return self._merged().drop("_batch")

    def version(self) -> int:
        """The last batch that the table has, -1 before any."""
        return max([self._base(), *self._whole("delta")])

    def compact(self) -> int:
        """All batches so far as a new base; older folders go with `vacuum`, once no reader is left that began before."""
        last = self.version()
        if last > self._base():
            self._merged().write.mode("overwrite").parquet(f"{self.path}/base-{last}")
        return last

    def vacuum(self) -> None:
        base = self._base()
        for kind in ("delta", "base"):
            for n in self._whole(kind):
                if n < base or kind == "delta" and n == base:
                    shared.remove(self.spark, f"{self.path}/{kind}-{n}")

    def _whole(self, kind: str) -> list[int]:
        found = [int(name.rpartition("-")[2]) for name in shared.names(self.spark, self.path) if name.startswith(f"{kind}-")]
        return sorted(n for n in found if "_SUCCESS" in shared.names(self.spark, f"{self.path}/{kind}-{n}"))

    def _base(self) -> int:
        return max(self._whole("base"), default=-1)

    def _merged(self) -> DataFrame:
        base = self._base()
        paths = [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/delta-{n}" for n in self._whole("delta") if n > base]
        kind = StructType([*self.schema.fields, *StructType.fromDDL("_batch int").fields])
        return self._reduced(self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind))

    def _reduced(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in [*self.schema.names, "_batch"] if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(*self.order, "_batch"))
        return rows.groupBy(*self.keys).agg(best.alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names, F.col("_batch").cast("int").alias("_batch"))
