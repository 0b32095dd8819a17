"""What a session needs: workers that can import this package, and scratch space that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to a Python worker at once, unless the session has its own setting.
BATCH_BYTES = 4 << 20
#: For Python workers, which live on after their tasks: large blocks go back to the system when they are freed.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_TOP_PAD_": str(1 << 20)}


def prepare(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path, bound the batches that workers get by bytes, and keep workers small.

    On a cluster ship the package with ``--py-files`` too.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":  # the default: rows of long texts would fill a worker's memory
        spark.conf.set(key, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_lodestone_scratch", None)
    if own is None:  # one machine only, as in tests
        own = spark.sparkContext._lodestone_scratch = tempfile.mkdtemp(prefix="lodestone-")
    return own


#: Scratch paths that nobody has deleted yet.
_OPEN: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    return path


def open_paths() -> list[str]:
    """The scratch paths that exist, oldest first."""
    return list(_OPEN)


def release(paths: Iterable[str], *kept: DataFrame) -> None:
    """Delete scratch paths but for those that the DataFrames ``kept`` read."""
    files = [f for df in kept for f in df.inputFiles()]
    for path in paths:
        if path in _OPEN and not any(f"/{path.rpartition('/')[2]}/" in f for f in files):
            _delete(_OPEN.pop(path), path)


@atexit.register
def _release_all() -> None:
    release(open_paths())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone first; the folder is scratch space
        pass
