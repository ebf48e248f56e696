"""A folder that driver and executors share, for what is written and read again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in local mode without it, below a temporary folder of this process. Deleted when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sightline-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    atexit.register(_gone, system, folder)
    return path


def _gone(system, folder) -> None:
    try:
        system.delete(folder, True)
    except Exception:  # noqa: S110  the session may have ended
        pass
