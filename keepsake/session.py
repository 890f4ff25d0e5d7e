"""Session defaults.

Nothing here is needed on a cluster whose ``spark-defaults`` already sets these;
``local_session`` is what tests and the bench use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", app: str = "keepsake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once below the folder the cluster names, and read it back.

    Later jobs, and tasks run again after an executor is lost, read the table. (``checkpoint()`` would compute ``df``
    twice, once for the action and once to write.)
    """
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for tables, stream state and sinks, below ``spark.checkpoint.dir``.

    A machine-local folder is only taken when that is unset *and* the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="keepsake-stream-")
    return f"{base.rstrip('/')}/keepsake-stream-{uuid.uuid4().hex}"
