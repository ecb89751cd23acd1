"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHARED = "spark.checkpoint.dir"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application.

    Functions that run in Python workers import it; a cluster's workers need not have it
    on their path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "kvspace.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster shares, named in ``spark.checkpoint.dir``.

    Where a session of one machine names none (as in tests), a temporary folder is set for it;
    a cluster's session has to name one.
    """
    base = spark.conf.get(_SHARED, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SHARED} names no folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SHARED, base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a table, in the folder that the cluster shares."""
    return f"{shared_base(spark)}/kvspace-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what reads it several times does not compute it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
