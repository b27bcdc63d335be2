"""The folder that driver and executors share, for what a run leaves behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset, and no other folder is shared by driver and executors")
        base = "file://" + tempfile.mkdtemp(prefix="loamfield-")
    return f"{base.rstrip('/')}/loamfield-runs/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: str | bytes) -> None:
    """One small file, written through the store's own client, its folders made on the way."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()
