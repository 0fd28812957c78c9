"""Session and cluster-folder helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests) a temporary one is set once; on a
    cluster no such folder would be shared, so there it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return spark.sparkContext.getCheckpointDir()


#: Bytes, as the planner estimates them, that a partition of a compacted table may have.
FILE_BYTES = 4 << 20


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in one partition for each ``FILE_BYTES`` of the planner's estimate, and at least four for each core.

    The estimate of an aggregate or join is not less than its input's, so the
    partitions grow with the data; where there are fewer of them already nothing is done.
    """
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(min(max(least, -(-bytes_ // FILE_BYTES)), (1 << 31) - 1))


#: Folders of tables that each application wrote.
_WRITTEN: dict[str, list[str]] = {}


def discard(spark: SparkSession) -> int:
    """Deletes the tables that :func:`materialise` wrote in this application, and says how many; results read from them must be saved before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


#: Spark removes the shuffle files of a write as soon as it is done, instead of when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(df: DataFrame, part: str = "") -> None:
    """Deletes a table that :func:`materialise` wrote, or one folder of it, that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    for path in _WRITTEN.get(spark.sparkContext.applicationId, []):
        if any(f"/{path.rpartition('/')[2]}/" in f for f in files):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}".rstrip("/"))
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, compact: bool = False, free: bool = False, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back; ``compact`` into no more files than its size asks for.

    The plan is cut there: a lost executor costs a reread, and the size of what
    was written is known to the planner. ``free``: what its shuffles wrote is
    removed at once; ``df`` itself must not be used again. ``by``: its last column, each value of which has a folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(FREED, None)
    if free:
        spark.conf.set(FREED, "true")
    try:
        (few_files(df) if compact else df).write.parquet(path, partitionBy=by)
    finally:
        if free:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)
