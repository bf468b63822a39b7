"""The folder that driver and executors share, for tables that are written on the way."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Used where spark.checkpoint.dir is unset and driver and executors are one process.
ONE_MACHINE = "/tmp/checkpoints"
_made: list[tuple] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in spark.checkpoint.dir. Without that setting a cluster has no such
    folder, and this raises. What is there goes when Python ends, or with forget."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = ONE_MACHINE
    path = f"{base.rstrip('/')}/weftline-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((path, at, at.getFileSystem(spark._jsc.hadoopConfiguration())))
    return path


def forget(path: str) -> None:
    """Delete what a path of shared_path holds."""
    for x in [x for x in _made if x[0] == path]:
        _made.remove(x)
        x[2].delete(x[1], True)


@atexit.register
def _forget_all() -> None:
    for _, at, fs in _made:
        try:
            fs.delete(at, True)
        except Exception:  # the JVM may have gone before
            return
