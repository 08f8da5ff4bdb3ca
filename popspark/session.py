"""One session builder, and tables written in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Only where that is unset and Spark runs in one process a
    local folder is taken; executors elsewhere would each write to a disk of their own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="popspark-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later rounds don't compute it again and it outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``saved``, in files that are read again with their true size.  A checkpoint keeps the estimate of its
    plan, which multiplies the sizes of joined tables; where rounds join their own results it grows to numbers
    of so many digits that planning takes longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
