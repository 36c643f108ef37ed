"""What Python workers need before they run this package's functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path where they share the driver's disk; on a cluster ship it with --py-files."""
    env = spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in path:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *path])
