"""A table that takes upserts: Parquet files by hash bucket of a key, made visible by a manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from docloom.sources.tables import materialize

_MANIFEST = "version long, bucket int, folder string, table_schema string, batch string"


@dataclass(frozen=True)
class Store:
    """The table below ``path``, whose rows belong to values of ``key``.

    A batch replaces all stored rows of the keys that it holds. It rewrites only
    the buckets that these keys lie in, below a folder of its own; the manifest
    of the new version, one small file with a row for each bucket, is written
    last. Until then readers see the version before, whose files stay as they
    are; what an interrupted batch has written is never looked at. One writer at
    a time. All paths go through Spark, so any file system that it reads will do.
    """
    path: str
    key: str
    buckets: int = 64

    def _manifest(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _MANIFEST)

    def version(self, spark: SparkSession) -> int:
        """The number of the newest version; 0 before the first batch."""
        return self._manifest(spark).agg(F.max("version")).first()[0] or 0

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; None before the first batch."""
        number = self.version(spark) if version is None else version
        entries = self._entries(spark, number)
        return self._rows(spark, entries, StructType.fromJson(json.loads(entries[0].table_schema))) if entries else None

    def _entries(self, spark: SparkSession, version: int) -> list:
        return self._manifest(spark).filter(F.col("version") == version).collect()  # a row for each bucket, and one of no bucket

    def _rows(self, spark: SparkSession, entries: list, schema: StructType) -> DataFrame:
        paths = [f"{self.path}/{e.folder}/_bucket={e.bucket}" for e in entries if e.bucket >= 0]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, order: list[Column] | None = None, removed: DataFrame | None = None, batch_id: str | None = None) -> int:
        """Put a batch in and return the version that holds it.

        With ``order`` a key has one row, the first by it; without, all rows of
        the batch stay. ``removed`` holds keys whose rows go. A null key is a key
        of its own. A ``batch_id`` that some version holds already is not put in
        again, so a batch that is repeated after a failure changes nothing. An
        empty batch makes a version like the one before; columns have to be those
        of the stored rows.
        """
        spark, key = batch.sparkSession, self.key
        known = self._manifest(spark)
        if batch_id is not None and (held := known.filter(F.col("batch") == batch_id).agg(F.max("version")).first()[0]):
            return held
        now = self.version(spark)
        entries = self._entries(spark, now)
        if order is not None:
            batch = batch.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")
        schema = StructType.fromJson(json.loads(entries[0].table_schema)) if entries else batch.schema
        if set(schema.fieldNames()) != set(batch.columns):
            raise ValueError(f"the store has columns {sorted(schema.fieldNames())}")
        batch = materialize(batch.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]), "batch")
        gone = batch.select(key) if removed is None else batch.select(key).union(removed.select(F.col(key).cast(schema[key].dataType)))
        gone = materialize(gone.distinct().withColumn("_bucket", self._bucket()), "keys")
        touched = {r[0] for r in gone.select("_bucket").distinct().collect()}  # at most ``buckets``
        stored = self._rows(spark, [e for e in entries if e.bucket in touched], schema)
        leaving = gone.select(F.col(key).alias("_key"))
        kept = stored.join(leaving, stored[key].eqNullSafe(leaving["_key"]), "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        # large buckets are split between tasks, small ones share one
        rows = kept.unionByName(batch).withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        rows.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        held = spark.read.schema(StructType(list(schema.fields)).add("_bucket", IntegerType())).parquet(f"{self.path}/{folder}")
        full = [r[0] for r in held.select("_bucket").distinct().collect()]
        says, number = json.dumps(schema.jsonValue()), now + 1
        lines = [(number, e.bucket, e.folder, says, batch_id) for e in entries if e.bucket >= 0 and e.bucket not in touched]
        lines += [(number, b, folder, says, batch_id) for b in full] + [(number, -1, "", says, batch_id)]
        spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return number

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete the files that only versions before the last ``keep`` hold, and return how many folders went; readers of those versions must have ended."""
        if keep < 1:
            raise ValueError("at least one version has to stay")
        last = self.version(spark)
        entries = self._manifest(spark).filter("bucket >= 0")
        live = entries.filter(F.col("version") > last - keep).select("bucket", "folder")
        dead = entries.filter(F.col("version") <= last - keep).select("bucket", "folder").distinct().join(live, ["bucket", "folder"], "left_anti").collect()
        jvm, gone = spark._jvm, 0
        for r in dead:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r.folder}/_bucket={r.bucket}")
            gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
