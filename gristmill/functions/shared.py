"""The folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``, which all executors share. In local mode alone, where the driver is the executor, a
    temporary folder serves if that is unset; it is removed when Python ends."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf:
        if not (sc.master or "").startswith("local") or "cluster" in sc.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = getattr(sc, "_gristmill_own", None)
        if not conf:
            conf = sc._gristmill_own = tempfile.mkdtemp(prefix="gristmill-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
    return f"{conf.rstrip('/')}/gristmill/{sc.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what is used again is computed once, and lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
