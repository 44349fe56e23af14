"""Token shards: one zstandard dictionary for all, one frame for each document.

Layout under a folder: ``dictionary`` (a one-row table: sha256, bytes) and ``shards`` (files of one
shard each, in ascending doc_id order over the files). A shard is

    magic | sha256 of the dictionary | id width | frames ... | index | index length (8 bytes) | tail

where the index (itself a zstandard frame) holds for each document its id, the frame's offset and
length and its number of ids, so one short document is read with one seek and one small frame.
Shards leave through Spark's own writer with its commit protocol, so lost executors and repeated
attempts leave no partial file, on any file system Spark can write.

The dictionary is trained first, on a bounded sample: of the ``sample_docs`` different rows with the
smallest hash of id and text, those of at most ``sample_bytes`` bytes. Only their hashes and then
their texts reach the driver, however large the corpus. Then each text is encoded and compressed in
one pass; what is dealt into shards are the compressed frames. Every document is written whole,
whatever its length.

Cases: null and empty texts hold the end id alone; null doc_ids come first, then ascending; equal
doc_ids are ordered by a hash of their frames and then by where they stood, repeated rows are all
written and may be parted between shards; an empty table writes a dictionary and no document; other
columns are ignored."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_BYTES, lean, materialise, scratch, slices, text_sample
from .encoding import encoder

MAGIC, TAIL = b"RWTOKEN1", "RWTE"
_HEAD = struct.Struct("<8s32sI")
_LEVEL = 3


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=_dict(raw), write_content_size=True)


def pack_shard(doc_ids: list[int | None], frames: list[bytes], n_tokens: list[int], raw: bytes, width: int) -> bytes:
    length = np.array([len(f) for f in frames], "<u8")
    head = _HEAD.pack(MAGIC, hashlib.sha256(raw).digest(), width)
    offset = np.cumsum(length, dtype="<u8") - length + len(head)
    known = np.array([x is not None for x in doc_ids], "u1")
    index = struct.pack("<Q", len(frames)) + known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + offset.astype("<u8").tobytes() + length.tobytes() + np.array(n_tokens, "<u8").tobytes()
    index = zstandard.compress(index)
    return b"".join([head, *frames, index, struct.pack("<Q", len(index))])


def shard_index(shard: bytes) -> dict[str, np.ndarray | bytes | int]:
    """The offset index of a shard, without its tail."""
    magic, sha, width = _HEAD.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<Q", shard, len(shard) - 8)
    raw = zstandard.decompress(shard[len(shard) - 8 - n : len(shard) - 8])
    (k,) = struct.unpack_from("<Q", raw)
    got = {"sha256": sha, "width": width, "known": np.frombuffer(raw, "u1", k, 8)}
    for i, (name, kind) in enumerate((("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8"))):
        got[name] = np.frombuffer(raw, kind, k, 8 + k + 8 * k * i)
    return got


def read_document(shard: bytes, at: int, raw: bytes, index: dict | None = None, reader: zstandard.ZstdDecompressor | None = None) -> np.ndarray:
    """The ids of the document at one place of a shard."""
    index = index or shard_index(shard)
    if index["sha256"] != hashlib.sha256(raw).digest():
        raise ValueError("the shard was written with another dictionary")
    reader = reader or zstandard.ZstdDecompressor(dict_data=_dict(raw))
    frame = shard[int(index["offset"][at]) : int(index["offset"][at] + index["length"][at])]
    return np.frombuffer(reader.decompress(frame), f"<u{index['width']}")


def frames(docs: DataFrame, tokenizer: str, end_id: int, width: int, raw: bytes) -> DataFrame:
    """(doc_id, n_tokens, frame): each text's ids with the end id, compressed."""
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(shared.value).compress
        for b in slices(batches, 4096, TEXT_BYTES):
            flat, ends = encoder(tokenizer, width).closed(b.column(1), end_id)
            view, at = memoryview(flat).cast("B"), (ends * width).tolist()
            packed = [press(view[i:j]) for i, j in zip([0, *at[:-1]], at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    return lean(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, frame binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, width: int = 2, dict_bytes: int = 65536, sample_docs: int = 1000, sample_bytes: int = 65536, shard_bytes: int = 8 << 20) -> None:
    spark = docs.sparkSession
    some = text_sample(docs, sample_docs, sample_bytes)
    flat, ends = encoder(tokenizer, width).closed(pa.array(some, pa.string()), end_id)
    raw = train_dictionary([x.tobytes() for x in np.split(flat, ends)[:-1]], dict_bytes)
    spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), bytearray(raw))], "sha256 string, bytes binary").write.parquet(f"{path}/dictionary")
    packed = materialise(frames(docs, tokenizer, end_id, width, raw), "token-frames")
    total = packed.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(raw)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            ids, n, got = (pa.Table.from_batches(kept).column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([pack_shard(ids, got, n, shared.value, width)], pa.binary())], names=["shard"])

    # where a row stands in the written frames sets even equal rows apart
    keys = ["doc_id", "tie", "place"]
    placed = packed.select("doc_id", F.xxhash64("frame").alias("tie"), F.concat_ws("/", "_metadata.file_name", "_metadata.row_index").alias("place"), "n_tokens", "frame")
    dealt = placed.repartitionByRange(max(1, -(-total // shard_bytes)), *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "frame")
    dealt.mapInArrow(pack, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("lineSep", TAIL).text(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, at, doc_id, local_start, n_tokens, ids_crc32) of every document, from the files."""
    sha, raw = spark.read.schema("sha256 string, bytes binary").parquet(f"{path}/dictionary").first()
    raw = bytes(raw)
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not have the hash it was written with")
    shared = spark.sparkContext.broadcast(raw)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=_dict(raw))
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = content.as_py()[: -len(TAIL)]
                index = shard_index(shard)
                n = index["n_tokens"].astype(np.int64)
                crc = [zlib.crc32(read_document(shard, i, raw, index, reader).astype("<u4").tobytes()) for i in range(len(n))]
                cols = [np.full(len(n), int(re.search(r"part-(\d+)", name)[1]), np.int64), np.arange(len(n)), None, np.cumsum(n) - n, n, np.array(crc, np.int64)]
                cols = [pa.array(c) if c is not None else pa.array(index["doc_id"], mask=index["known"] == 0) for c in cols]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "at", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select("path", "content").mapInArrow(unpack, "shard long, at long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, **options: int) -> DataFrame:
    """Writes the shards and returns, from the files: doc_id, start, n_tokens, ids_crc32, shard, at."""
    path = path or scratch(docs.sparkSession, "token-store")
    write_tokens(docs, path, tokenizer, **options)
    docs_read = materialise(read_tokens(docs.sparkSession, path), "token-read")
    # one row for each shard: a prefix sum over shards, not over documents
    shards = docs_read.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs_read.join(before, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "at")
