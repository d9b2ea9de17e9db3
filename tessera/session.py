"""Session factory and the shared-folder helpers every multi-stage operator uses."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (tests) is a temporary folder made and set; on a cluster it is an error, since
    every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage with files that outlive any executor, unlike a cached or locally
    checkpointed frame, and it fixes the partitioning later reads see.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files alone would occupy less than half of them.

    For work that costs far more than moving its rows. An input that fills the cluster by itself is left as it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * split // 2 else df


def discard(*kept: DataFrame, tidy: bool = True) -> None:
    """Delete kept tables that nothing reads any more, and let the JVM drop the shuffle files behind them.

    Shuffle files go when the driver's JVM collects the plan that made them; a long job would
    otherwise hold those of all its steps at once. Short steps leave that to a later call (``tidy``).
    """
    for df in kept:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if kept and tidy:
        _collect(kept[0].sparkSession)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(spark: SparkSession) -> None:
    """Let the JVM drop the shuffle files of steps that are over, where there is no table to discard."""
    _collect(spark)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system Spark can read, or None if there is none."""
    where, files = _file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename over, so that a reader sees the old or the new file, never half."""
    jvm = spark.sparkContext._jvm
    beside, files = _file_system(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    where = files.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(beside), where, how)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that must not be there yet; False if it is."""
    where, files = _file_system(spark, path)
    files.mkdirs(where.getParent())
    try:
        stream = files.create(where, False)
    except Exception as e:
        if files.exists(where):
            return False
        raise e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path if "://" in path or ":/" in path else "file://" + path)
    return files.exists(where)


def delete_file(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
