"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The tables written so far inside each open ``passing``, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a local master gets a temporary folder and a
    cluster its warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="roadweave-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        return "file://" + _LOCAL[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialise(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """The rows, written and read again. Inside ``passing`` the table goes with the others at its
    end; a ``lasting`` one stays until the end of the next around it, if any."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    for made in _MADE.get()[:-1][-1:] if lasting else _MADE.get()[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialise`` wrote inside, at the end: what is read later must not
    read them, so it is written as ``lasting``."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
