"""Session helpers that every subpackage may use: code shipping, shared folders, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

#: Spark's own 64 MB are held several times over, by the JVM and by each worker, and are hardly given back.
ARROW_BYTES = 4 << 20
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []  # paths made inside each open ``scratch``


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, so Python workers can import it.

    Where the session doesn't say how large Arrow batches may be, it is set to ``ARROW_BYTES``.
    """
    sc = spark.sparkContext
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docweave-"), "docweave_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in local
    mode is a temporary folder made and set; on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="docweave-shared-")
    sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared root; nothing is created yet."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared root, by the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``shared_path`` and ``cut`` make inside goes at the end: write the result before, to a path made outside."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove_path(spark, path)


def cut(df: DataFrame, name: str = "cut", **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages start from files that survive the loss of any executor, and column pruning and
    row-count statistics apply to what is read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the folder of what ``cut`` gave, once nothing reads it any more."""
    for path in {unquote(f.rsplit("/", 1)[0]) for f in written.inputFiles()}:
        remove_path(written.sparkSession, path)
