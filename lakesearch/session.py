"""Session settings the jobs are written for, and the shared checkpoint folder."""

import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call sites for error messages cost the driver several calls per column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "8", memory: str = "16g", app: str = "lakesearch") -> SparkSession:
    """A single-machine session with the settings above, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per session."""
    context = spark.sparkContext
    if getattr(context, "_lakesearch_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lakesearch-package-"), "lakesearch")
    context.addPyFile(shutil.make_archive(target, "zip", root, "lakesearch"))
    context._lakesearch_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that `spark.checkpoint.dir` names.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local one would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lakesearch-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it does not exist."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return [status.getPath().getName() for status in files.listStatus(target)]


def rename_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, without replacing anything; false if the target exists."""
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    old, new = fs.Path(source), fs.Path(target)
    files = old.getFileSystem(context._jsc.hadoopConfiguration())
    qualified = files.makeQualified(old)
    options = context._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(qualified.toUri(), context._jsc.hadoopConfiguration()).rename(
            qualified, files.makeQualified(new), options
        )
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName() == "org.apache.hadoop.fs.FileAlreadyExistsException":
            return False
        raise
    return True
