"""Session helpers: shipping this package to executors and the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIRS: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application.

    Python workers import functions by name, so they need the package wherever the
    driver found it; ``addPyFile`` copies it to executors that join later as well.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target.resolve()))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, one
    machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_tidemark_shared", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(base)
        spark.sparkContext._tidemark_shared = base
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex[:12]}-{label}"
    if not _OWN_DIRS:
        atexit.register(_remove_dirs)
    _OWN_DIRS.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_dirs() -> None:
    for spark, path in _OWN_DIRS:
        try:
            drop_dir(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans it
            return


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
