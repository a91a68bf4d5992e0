"""Session settings the jobs rely on, and the shared work folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: adaptive plans with skew handling, and joins that may reuse a coarser partitioning.

    Block tables are hash-partitioned by (frame_id, stripe); with the co-partition rule relaxed a join on
    (frame_id, stripe, block) runs in place instead of shuffling both sides again.  HotSpot never compiles a
    method above 8000 bytecodes, so a fused stage that large runs interpreted; below the limit Spark falls back to
    per-operator code, which it splits into small compiled methods (several times faster for the wide arithmetic here).
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("blockfield")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


#: The folder of this driver where the cluster names none; for local mode only.
_LOCAL = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="blockfield-"))
    return _LOCAL[0]


def work_dir(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"work-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


#: Work paths given out by this driver; a path may have companions that begin with its name.
_MADE = []


def clean_work() -> int:
    """Delete what this driver's jobs have staged in the shared folder; returns the number of folders.

    To be called once results are written elsewhere: tables that jobs have returned, and streams that still run, read from there.
    Checkpoints that Spark's cleaner removes by itself are among them.
    """
    from pyarrow import fs

    gone = 0
    for path in _MADE:
        system, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        base, name = root.rsplit("/", 1)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(name) and info.type == fs.FileType.Directory:
                system.delete_dir(info.path)
                gone += 1
    _MADE.clear()
    return gone


def stage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the plan, survives lost executors, keeps the partitioning."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def write_table(df: DataFrame) -> DataFrame:
    """Columnar table in the shared folder, for results several consumers read different columns of."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
