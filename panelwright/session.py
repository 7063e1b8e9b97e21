"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package relies on. Adaptive execution picks broadcast joins from
# measured sizes and splits skewed join partitions, so no plan carries an unchecked broadcast hint.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Only matters for small inputs: text checks cost far more per byte than the default assumes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For plans of many columns and many written tables.
WIDE_SETTINGS = {
    # The JVM never compiles a longer method: the one loop that Spark writes for many columns would be interpreted. Above
    # this it writes a projection per operator instead, in pieces that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Shuffle files go as soon as the write or count that made them ends, not when the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession, wide: bool = True) -> SparkSession:
    for key, value in (SQL_SETTINGS | WIDE_SETTINGS if wide else SQL_SETTINGS).items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver and executors share.

    Without it there is no place that every executor can read back, so this is an error and never a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    For a table that several later steps read: they then scan only the columns they need, nothing upstream is
    computed twice, and a lost executor costs no more than its own part of the scan."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/panelwright-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths that were written while a `settle` is under way, the outermost first.
_open: list[list[str]] = []


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written; the tables written on the way are removed, as nothing reads them any more.

    For steps whose result is far smaller than what they write in between. The result must not be computed before
    `make` returns it, and `make` must give away no other table."""
    made: list[str] = []
    _open.append(made)
    try:
        df = make()
        _open.pop()
        result = cut_lineage(df)
    except BaseException:
        if made in _open:
            _open.remove(made)
        raise
    spark = df.sparkSession
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return result
