"""Session helpers: a local session for tests and benchmarks, and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tripweave", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and bench.py; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names in spark.checkpoint.dir.

    A temporary folder is used only on a local master where nothing is configured.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripweave-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores; leave any other alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}/{uuid.uuid4().hex}"


def write_through(df: DataFrame) -> DataFrame:
    """Write a reduction that several later steps read to the shared folder, and read it back.

    Unlike a checkpoint the table is columnar: readers prune columns, and its true size lets the
    planner broadcast it where it is small. Lost executors cost a re-read.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, calls: list[Callable], threads: int = 4) -> list:
    """Results of calls that do not depend on each other, in their order; so many driver threads submit their jobs at a time.

    A fit is a row of short jobs that leave cores idle between them, which those of another fill.
    """
    with ThreadPoolExecutor(max(1, min(threads, len(calls)))) as pool:
        # Each submission copies the caller's job properties to the thread that runs it.
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def clean_up(spark: SparkSession) -> None:
    """Delete what this application wrote below its checkpoint folder: tables of write_through, checkpoints, scratch files.

    Spark gives every application a folder of its own there, so nothing of others is touched. Call it when the results are
    written elsewhere; frames read from those tables are unusable afterwards.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and cut its lineage there.

    The rows live on shared storage, so a lost executor costs a re-read, not a recomputation, and
    every later use sees the same rows in the same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
