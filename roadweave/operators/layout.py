"""Arrays that all Python workers of an executor share.

A broadcast reaches each executor as one file. Its arrays are mapped from there, not read, so that
workers have the pages in common; where Spark encrypts what it writes, each worker reads its own."""

from __future__ import annotations

import mmap
import pickle
import uuid

import numpy as np
from pyspark import SparkContext

_MARK, _HEAD = b"roadweave-arrays", 32


def _lead() -> int:
    """Bytes that pickling puts before a large bytearray."""
    return pickle.dumps(bytearray(_MARK) + bytearray(1 << 20), pickle.HIGHEST_PROTOCOL).index(_MARK)


def ship(sc: SparkContext, arrays: dict[str, np.ndarray], rest: object = None) -> tuple:
    """Broadcasts the arrays, and a small object beside them, with a key for what is made of them."""
    at, table = 0, {}
    for name, a in arrays.items():
        table[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = pickle.dumps((table, rest))
    pad = -(_lead() + _HEAD + len(head)) % 64
    start = _HEAD + len(head) + pad
    # never so short that it would be pickled within a frame
    out = bytearray(max(start + at, 1 << 17))
    out[: len(_MARK)] = _MARK
    out[16:24], out[24:32] = len(head).to_bytes(8, "little"), start.to_bytes(8, "little")
    out[_HEAD : _HEAD + len(head)] = head
    for name, a in arrays.items():
        kind, n, place = table[name]
        np.frombuffer(out, kind, n, start + place)[:] = a
    return sc.broadcast(out), uuid.uuid4().hex


def mapped(shared) -> tuple[dict[str, np.ndarray], object]:  # noqa: ANN001
    """The arrays of a broadcast and the object beside them."""
    buffer, at = None, -1
    path = getattr(shared, "_path", None)
    if path and getattr(shared, "_sc", None) is None:
        with open(path, "rb") as f:
            buffer = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = buffer.find(_MARK, 0, 4096)
    if at < 0:
        buffer, at = shared.value, 0
    n, start = (int.from_bytes(buffer[at + k : at + k + 8], "little") for k in (16, 24))
    table, rest = pickle.loads(buffer[at + _HEAD : at + _HEAD + n])
    return {name: np.frombuffer(buffer, kind, count, at + start + place) for name, (kind, count, place) in table.items()}, rest
