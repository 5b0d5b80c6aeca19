"""Tables written once and read again: they cut lineage, and fix what would differ if it were computed twice.

They go to the folder named in ``spark.checkpoint.dir`` (read from the session), which driver and executors share.
Only a local session without that setting, as in tests, gets a temporary folder; any other one raises. All of them
are deleted when the session's JVM ends, at the latest.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made = threading.local()  # folders that a thread has made


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/") + "/quadrille"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quadrille-"))
        atexit.register(shutil.rmtree, _own_dir[0].removeprefix("file://"), ignore_errors=True)
    return _own_dir[0]


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


def new_path(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.paths = [*paths(), folder]
    return folder


def paths() -> list[str]:
    """Folders that this thread has made in the shared folder and not released."""
    return list(getattr(_made, "paths", []))


def release(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that nothing reads any more, wherever Spark's file systems have them."""
    for folder in folders:
        fs, path = _path(spark, folder)
        fs.delete(path, True)
    _made.paths = [p for p in paths() if p not in folders]


def collected(spark: SparkSession) -> None:
    """Lets the driver drop what ended jobs have left: plans, metrics, broadcasts and the shuffle files they keep alive.

    Its heap grows with garbage up to its limit otherwise, however little of it is in use; after a full collection it
    shrinks to what is. For loops of many small jobs; a call takes under a second.
    """
    gc.collect()  # Python's frames hold the JVM's
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, so a lost executor
    costs a read, not a recomputation."""
    spark, folder = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(folder)
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Releases, at the end, the folders made inside, but for those added to the set it gives (see ``keep``)."""
    before, kept = set(paths()), set()
    try:
        yield kept
    finally:
        release(spark, *[p for p in paths() if p not in before and p not in kept])


def keep(kept: set[str], df: DataFrame) -> DataFrame:
    """``df``, whose last written folder outlives the scratch that ``kept`` belongs to."""
    kept.add(paths()[-1])
    return df
