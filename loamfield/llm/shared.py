"""Tables written between the steps of one operator.

Executors and the driver share only the folder named in ``spark.checkpoint.dir``
(the warehouse and the inputs aside), so a step that has to be read more than once is
written there as Parquet.  A lost executor then costs no more than the tasks it held.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def released() -> None:
    """Gives this process's free memory back."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def lean(function: Callable) -> Callable:
    """A batch function that gives its free memory back when its task ends.

    Python workers live on between tasks, and an allocator keeps what they once needed; on an
    executor that adds up over the steps of a pipeline.
    """

    @functools.wraps(function)
    def run(*args, **kwargs):
        try:
            yield from function(*args, **kwargs)
        finally:
            released()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loamfield.shared.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset, and no other folder is shared by driver and executors")
        folder = "file://" + tempfile.mkdtemp(prefix="loamfield-")
        spark.conf.set("loamfield.shared.dir", folder)
    return folder.rstrip("/")


#: Folders written since each :func:`passing` that is open began, the innermost last.
_PASSING: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("passing", default=())


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """What runs inside deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it; ``lasting`` tables outlive the innermost :func:`passing`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loamfield/{name}-{uuid.uuid4().hex}"
    open_ = _PASSING.get()
    at = len(open_) - 1 - lasting
    if at >= 0:
        open_[at].append(path)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables written inside are deleted at the end: for steps whose result is stored by then, or written as ``lasting``.

    Inside another, ``lasting`` tables go at the end of the outer one.
    """
    held: list[str] = []
    token = _PASSING.set((*_PASSING.get(), held))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in held:
            deleted(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Ids are sent to all executors up to this many (8 bytes each), else joined by a shuffle.
MOST_SENT = 1_000_000


def chosen(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows with one of the doc_ids of ``ids`` (a written table of one column), or with none of them by ``left_anti``."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", how)
