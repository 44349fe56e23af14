"""Shared helpers: reading tables, the scratch folder of the engine, samples, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scratch import materialise, passing  # noqa: F401  for the operators here
from ..plans.scratch import scratch_path as scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows handed to Python at a time, so that few texts are held as Python strings, and bytes where
#: the texts stay in Arrow.
ROWS, TEXT_BYTES = 1024, 4 << 20
_OWNER: list = [None, None]


def release() -> None:
    """Gives freed memory back to the system, where it knows how: processes outlive what they ran."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release_heaps(spark: SparkSession) -> None:
    """The same for executors: a heap else stays as large as its largest stage made it, beside the
    Python workers of the next. A task a core reaches all of them where no other job runs."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def own_cache(name: str, clear: Callable[[], None]) -> None:
    """Python workers outlive stages: the operator that begins in one drops the last one's caches."""
    if _OWNER[0] != name:
        if _OWNER[1]:
            _OWNER[1]()
            release()
        _OWNER[:] = [name, clear]


def lean(df: DataFrame) -> DataFrame:
    """The same rows; their session hands them to Python in batches of few bytes, so that executors
    and workers hold few long texts at a time."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) not in range(1, 2 * TEXT_BYTES + 1):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * TEXT_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, and of about ``most`` bytes if told (one long row may be more)."""
    for batch in batches:
        n = rows if not most or not batch.num_rows else min(rows, max(1, most * batch.num_rows // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, n):
            part = batch.slice(k, n)
            if most and n > 1 and part.nbytes > 4 * most:  # long rows side by side
                yield from slices([part], max(1, n // 4), most)
            else:
                yield part


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those of kinds that cannot be hashed are taken as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes))


def text_sample(docs: DataFrame, most: int, most_bytes: int) -> list[str]:
    """A bounded sample to fit something on: of the ``most`` different rows with the smallest hash of
    id and text, among those of 1 to ``most_bytes`` bytes. The driver gets hashes, then those texts."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), "text").where(F.octet_length("text").between(1, most_bytes))
    # repeated rows have one hash; a task hands over its smallest ones only
    chosen = keyed.select("h").distinct().orderBy("h").limit(most)
    taken = keyed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.any_value("text").alias("text"))
    return [r.text for r in sorted(taken.collect(), key=lambda r: r.h)]


def map_arrow(df: DataFrame, columns: list[str], schema: str | StructType, rows: Callable[[dict], dict], names: list[str]) -> DataFrame:
    """Runs ``rows`` over Arrow batches of the named columns only. ``rows`` takes a dict of Python
    lists and returns a dict of lists (or Arrow arrays) for ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = rows({c: batch.column(i) for i, c in enumerate(columns)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in (got[n] for n in names)], names=names)

    return lean(df).select(*columns).mapInArrow(run, schema)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids count as the text of the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def local_path(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def is_local(path: str) -> bool:
    return path.startswith(("file:", "/")) or os.path.isabs(path)
