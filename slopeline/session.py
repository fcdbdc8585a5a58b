"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local(cpus: int = 8, **settings: str) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("slopeline")
    base = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g",
    }
    for k, v in (base | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a local session gets a folder of its own (tests); a cluster is refused, as
    no other machine would see that folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: cuts the lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read back: for loops that join a table with itself round after round.

    A checkpoint keeps the estimate of its plan's size. Such a loop squares it each round, until planning alone
    never ends; a table is planned by the size of its files.
    """
    folder = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
