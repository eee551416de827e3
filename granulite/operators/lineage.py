"""Cut lineage: small, dear or iterated tables are written to the shared folder, never kept on one machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only on a local session without one, a temporary folder is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="granulite-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there; unlike a checkpoint its last stage runs only once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


settle = written
