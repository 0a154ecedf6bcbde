"""Session defaults and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the library is written for. All of them can be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_LOCAL_STAGING: dict[str, str] = {}
# paths handed out per application
_STAGED: dict[str, list[str]] = {}


def build_session(master: str | None = None, app: str = "sluice", **conf: str) -> SparkSession:
    """Session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is made only for a local master (tests); on a cluster an
    unset folder is an error, because executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGING:
        _LOCAL_STAGING[app] = tempfile.mkdtemp(prefix="sluice-")
    return _LOCAL_STAGING[app]


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, noted for :func:`clear_staging`."""
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark uses for it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staging(spark: SparkSession) -> int:
    """Delete what this application has staged; returns the number of folders.

    Results read staged tables lazily, so this is for after their last action. Folders of other applications are not touched.
    """
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_folder(spark, path)
    return len(paths)


def bound_scans(spark: SparkSession) -> None:
    """Scans of at most 32 MB of files a task in this session, unless it has a size of its own.

    Envelopes and logs shrink to a tenth in files, and what a task sorts of Spark's 128 MB is a gigabyte of rows.
    """
    key = "spark.sql.files.maxPartitionBytes"
    if spark.conf.get(key) in ("134217728b", "134217728", "128MB", "128m"):
        spark.conf.set(key, "32m")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cache the result survives lost executors, and later passes still prune
    columns and see real sizes when Catalyst picks a join.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
