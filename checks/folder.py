"""The shared folder of a local session, for checks, bench and tests. Clusters name their own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Name a folder where none is set and one process does all the work; on a cluster the setting must be there."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelwright-"))
    return spark
