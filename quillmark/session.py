"""Session helpers: a local session for tests and benches, tables by name, cutting of lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "quillmark", **conf: str) -> SparkSession:
    """A local session with the settings the queries expect; on a cluster the caller brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("QUILLMARK_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one (tests, a laptop) gets a temporary
    folder, as a machine's own folder is of no use to a cluster."""
    sc = spark.sparkContext
    if (held := sc.getCheckpointDir()) is not None:
        return held
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillmark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, written to the shared checkpoint folder, so that a lost executor
    costs no more than the tasks it ran."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is cut within leaves no shuffle files: they go as soon as the rows are written, not when the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """A scan, on which dear work follows, over as many partitions as there are cores: few small files are dealt
    out, while tables of many files stay as they are and are not shuffled. So does what is no mere scan."""
    plan = scan._jdf.queryExecution()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
