"""The folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, below ``spark.checkpoint.dir``; where that is unset, as on one machine, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    base = base if ":/" in base else "file://" + os.path.abspath(base)
    return f"{base}/ledgerloom/{label}-{uuid.uuid4().hex}"
