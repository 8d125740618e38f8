"""Intermediate tables that are read more than once, written where every executor can reach them.

A written table cuts the lineage, survives the loss of executors, and keeps column pruning and a known size for the
reads that follow, which a plan that is planned twice, or a cached block, does not.  All tables of an application are in
one folder, which goes when the program ends with the session still open, or at ``release``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Called with each table before it is stored, for tests that look at plans.
WATCHERS: list[Callable[[DataFrame], None]] = []

_LOCAL: dict[str, str] = {}
_OWNED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one only for a local session without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL[application]


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path for a table of this application, nothing there yet."""
    own = f"{shared_folder(spark)}/routeloom-{spark.sparkContext.applicationId}"
    if not _OWNED:
        atexit.register(_release_open)
    _OWNED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written once as Parquet and read back."""
    for watcher in WATCHERS:
        watcher(df)
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables of this application; results that read them are void from then on."""
    own = f"{shared_folder(spark)}/routeloom-{spark.sparkContext.applicationId}"
    if own in _OWNED:
        _remove(spark.sparkContext, own)
        _OWNED.discard(own)


def _remove(context: SparkContext, folder: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _release_open() -> None:
    context = SparkContext._active_spark_context
    for folder in list(_OWNED):
        if context is not None and context._jsc is not None and folder.endswith(f"-{context.applicationId}"):
            _remove(context, folder)
