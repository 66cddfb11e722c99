"""Session settings the jobs are written for, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4
from weakref import finalize

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # AQE sizes the reducers, splits skewed join partitions and turns a join into
    # a broadcast only when the measured side is under the threshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "aislewise") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # driver and executors are one JVM
            builder = builder.config("spark.driver.memory", "14g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="aislewise-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")


# Whether a query's shuffle files are deleted at its end.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}
_OWN_FOLDERS: set[str] = set()
_PATHS: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    application = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="aislewise-")
    return _LOCAL_FOLDERS[application]


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. It is deleted when the driver's process ends."""
    folder = "/".join([shared_folder(spark), spark.sparkContext.applicationId])
    if folder not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(folder)
        files, path = _file(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def _file(spark: SparkSession, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, name: str) -> bool:
    files, path = _file(spark, name)
    return files.exists(path)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; where the target appeared meanwhile, that one stays."""
    files, path = _file(spark, source)
    _, at = _file(spark, target)
    if files.exists(at) or not files.rename(path, at):
        if not files.exists(at):
            raise OSError(f"could not rename {source} to {target}")
        files.delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside, as it was afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results that several later branches read: they are computed once, every branch
    sees the same values, the lineage ends here, and a lost executor only costs a re-read.
    The file lives in the application's own folder, which goes when the application ends. What was
    shuffled for it leaves the disk as soon as it is written, not when the driver next collects.
    """
    spark = df.sparkSession
    path = "/".join([own_folder(spark), uuid4().hex])
    with setting(spark, _CLEANED, "true"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(back)] = path
    finalize(back, _PATHS.pop, id(back), None)
    return back


def released(df: DataFrame) -> None:
    """Delete the file behind a result of ``stored`` once nothing reads it any more: a later
    ``stored`` result has replaced it. Other frames are left alone."""
    path = _PATHS.pop(id(df), None)
    if path:
        files, at = _file(df.sparkSession, path)
        files.delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="aislewise-")) / "aislewise-package.zip"
    with zipfile.ZipFile(bundle, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(bundle))
