"""Input tables, and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where all tasks share this machine, one of its own if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not f'{spark.conf.get("spark.master", "local")}['.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and pins non-deterministic columns: what is read back no
    longer depends on any executor that took part in writing it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_json(documents: DataFrame, path: str) -> None:
    """Documents as JSON, one to a line, null fields included; folders above ``path`` are made."""
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
