"""Session construction and the shared scratch folder.

Intermediate results that must survive the loss of an executor are written as
Parquet under the folder the cluster names in ``spark.checkpoint.dir``. Only
where that setting is missing and the master is local (tests, a laptop) is a
local folder created; on a cluster without it an error is raised.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_shared: dict[str, str] = {}


def build_session(app: str = "vellum", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and Arrow; cluster settings are left to spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read; its own sub-folder per application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            # A folder of this machine would be another on every executor.
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _local_shared:
            _local_shared[app] = tempfile.mkdtemp(prefix="vellum-")
        base = _local_shared[app]
    return f"{base.rstrip('/')}/vellum-{app}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


_registered: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back.

    Cuts the lineage, so that later loops and lost executors recompute nothing
    before this point. Its shuffle files are deleted as soon as it is written, the
    application's folder at exit.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _registered:
        _registered.add(root)
        atexit.register(_delete, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that ``materialise`` returned."""
    spark, total = df.sparkSession, 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        total += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return total


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` returned and that nothing reads any more."""
    root = shared_dir(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.replace("file://", "").startswith(root.replace("file://", "")):
            _delete(df.sparkSession, folder)


def within_bytes(df: DataFrame, limit: int) -> bool:
    """True if Catalyst's size estimate of ``df`` (from file sizes) is at most ``limit``."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit
