"""Session helpers shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int = 8, app: str = "siftwire", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    have = os.environ.get("PYTHONPATH", "")
    if str(ROOT) not in have.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), have) if x)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A temporary one is set only where there is none and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are kept in the shared checkpoint folder, so lost executors do not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How much of a plan's text Spark keeps for its status pages, and no Bloom filters beside joins: a checkpoint's
#: size counts as unknown, so each join with one would get a filter that goes through the driver and into every task's closure.
_FRUGAL = {"spark.sql.maxPlanStringLength": "2048", "spark.sql.debug.maxToStringFields": "4", "spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}


@contextmanager
def short_plan_texts(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside leave only the beginning of their plans' texts, and no Bloom filters in the driver.

    The driver keeps the texts of the last thousand plans, with or without status pages; those of iterative work
    add up to hundreds of MB. The session's own settings are put back at the end.
    """
    before = {key: spark.conf.get(key) for key in _FRUGAL}
    try:
        for key, value in _FRUGAL.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
