"""Token counts of documents in flat token files that carry no index.

Such a file is nothing but ids, each document closed by the end-of-document id. Files are cut into
blocks of fixed size, wherever documents may end. Each block is searched for the separator in one
vectorised comparison, giving the lengths between separators and the block's head and tail; a prefix
scan over one summary row for each block then carries unfinished documents over block boundaries (a
document may span many blocks). Ids after a file's last separator form an unclosed document, which
is counted and marked.

Texts are encoded straight into the files, in one pass without a shuffle or a copy: each task writes
one flat file through Spark's text writer with the separator's bytes as line end, so the file is flat
by construction and commits like any Spark output. Beside it the same task writes the documents' ids
in the same order, as records of fixed size; the scan itself never looks at those, they only name
what it found. Blocks are read by offset where the file system can be opened from Python; elsewhere
Spark hands over whole files, which the same code cuts into blocks.

Cases: null and empty texts count zero tokens; repeated rows and ids are separate documents; null
doc_ids are returned as such; an empty table gives an empty result; the separator cannot arise from
text, as special tokens that a text spells out are encoded as ordinary text; other columns are
ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_BYTES, is_local, lean, local_path, materialise, scratch, slices
from .encoding import encoder

#: Bytes of an id: the vocabularies in use stay under 65,536 (the encoder checks it).
ID_BYTES = 2
#: Of a document's record: whether its id is known, and the id.
_RECORD = np.dtype([("known", "u1"), ("doc_id", "<i8")])
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """``kind=ids`` holds the flat files and ``kind=docs`` the documents' ids, file by file."""
    spark = docs.sparkSession
    end = int(end_id).to_bytes(ID_BYTES, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096, TEXT_BYTES):
            flat, ends = encoder(tokenizer, ID_BYTES, True).encode(b.column(1))
            offsets = pa.py_buffer(np.concatenate(([0], ends * ID_BYTES)).astype("<i8").tobytes())
            ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(["ids"] * len(ends))], names=["value", "kind"])
            record = np.zeros(len(ends), _RECORD)
            record["known"] = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            record["doc_id"] = b.column(0).fill_null(0).to_numpy()
            raw = record.tobytes()
            size = _RECORD.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary()), pa.array(["docs"] * len(ends))], names=["value", "kind"])

    found = lean(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "value binary, kind string")
    # two open files a task instead of a sort by kind, so rows keep their order
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "2")
    try:
        found.select(F.col("value").cast("string").alias("value"), "kind").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)
    finally:
        spark.conf.set(_WRITERS, before)


def scan_block(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """Lengths of what each separator of the block closes within it, and the ids after the last."""
    ends = np.flatnonzero(ids == end_id)
    return np.diff(ends, prepend=-1) - 1, len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)


def _opens(path: str) -> bool:
    if is_local(path):
        return True
    try:
        pyarrow.fs.FileSystem.from_uri(path)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


_SCHEMA = "file string, block long, k long, n long, closed boolean"


def _batch(file: str, block: int, lengths: np.ndarray, tail: int) -> pa.RecordBatch:
    m = len(lengths) + 1
    return pa.RecordBatch.from_arrays([pa.array([file] * m), pa.array(np.full(m, block, np.int64)), pa.array(np.arange(m)), pa.array(np.append(lengths, tail).astype(np.int64)), pa.array(np.arange(m) < m - 1)], names=["file", "block", "k", "n", "closed"])


def _name(path: str) -> str:
    """The part of the file's name that a task's files share."""
    return re.search(r"part-\d+", path)[0]


def scan_files(spark: SparkSession, path: str, end_id: int, block_bytes: int = 4 << 20, id_bytes: int = ID_BYTES) -> DataFrame:
    """One row for each separator of each block, and one for each block's tail (not closed)."""
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if _opens(path):

        def by_offset(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for file, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    fs, name = (pyarrow.fs.LocalFileSystem(), local_path(file)) if is_local(file) else pyarrow.fs.FileSystem.from_uri(file)
                    with fs.open_input_file(name) as f:
                        raw = f.read_at(block_bytes, block * block_bytes)
                    yield _batch(_name(file), block, *scan_block(np.frombuffer(raw, kind), end_id))

        blocks = files.select(F.col("path").alias("file"), F.explode(F.expr(f"sequence(0L, greatest(0L, ceil(length / {block_bytes}) - 1))")).alias("block"))
        return blocks.repartition(F.col("file"), F.col("block")).mapInArrow(by_offset, _SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), kind)
                step = block_bytes // id_bytes
                for k in range(max(1, -(-len(raw) // step))):
                    yield _batch(_name(file), k, *scan_block(raw[k * step : (k + 1) * step], end_id))

    return files.select("path", "content").mapInArrow(whole, _SCHEMA)


def count_tokens(spark: SparkSession, path: str, end_id: int, block_bytes: int = 4 << 20, id_bytes: int = ID_BYTES) -> DataFrame:
    """file, doc_no (place in the file), doc_seq (place over all files in name order), n_tokens, closed."""
    found = materialise(scan_files(spark, path, end_id, block_bytes, id_bytes), "token-scan")
    by = Window.partitionBy("file").orderBy("block")
    # one row for each block; its k is the number of separators in it
    tails = found.where("not closed").select("file", "block", F.col("k").alias("ends"), F.col("n").alias("tail"))
    # blocks without separator belong to the stretch that the last block with one began
    tails = tails.withColumn("stretch", F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(by), F.lit(0)))
    upto = Window.partitionBy("file", "stretch").orderBy("block")
    tails = tails.withColumn("open", F.sum("tail").over(upto))
    tails = tails.withColumn("carry", F.coalesce(F.lag("open").over(by), F.lit(0))).withColumn("docs_before", F.sum("ends").over(by) - F.col("ends"))
    tails = tails.withColumn("last", F.lead("block").over(by).isNull())
    per_file = tails.groupBy("file").agg((F.sum("ends") + F.max(F.when(F.col("last") & (F.col("open") > 0), 1).otherwise(0))).alias("docs"))
    first = per_file.select("file", (F.sum("docs").over(Window.orderBy("file")) - F.col("docs")).alias("first"))
    known = tails.select("file", "block", "carry", "docs_before", "last", "open").join(first, "file")
    rows = found.join(known, ["file", "block"]).where("closed or (last and open > 0)")
    number = F.col("docs_before") + F.col("k")
    tokens = F.when(~F.col("closed"), F.col("open")).otherwise(F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0))
    return rows.select("file", number.alias("doc_no"), (F.col("first") + number).alias("doc_seq"), tokens.alias("n_tokens"), "closed")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_no, doc_id of the documents, from the records that lie beside the flat files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _RECORD.itemsize + ID_BYTES
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, step)
                record = np.ascontiguousarray(raw[:, : _RECORD.itemsize]).view(_RECORD)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([_name(file)] * len(record)), pa.array(np.arange(len(record))), pa.array(record["doc_id"].copy(), mask=record["known"] == 0)], names=["file", "doc_no", "doc_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(rows, "file string, doc_no long, doc_id long")


def flat_token_counts(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """Writes the texts as flat token files and counts the tokens of each document from them:
    doc_id, n_tokens, file, doc_no, doc_seq, closed."""
    spark = docs.sparkSession
    path = path or scratch(spark, "flat-tokens")
    write_flat(docs, path, tokenizer, end_id)
    if spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, doc_no long, doc_seq long, closed boolean")
    counts = count_tokens(spark, f"{path}/kind=ids", end_id, block_bytes)
    return counts.join(read_names(spark, f"{path}/kind=docs"), ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "doc_no", "doc_seq", "closed")
