"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at four or fewer differing bits differ in at most four of their eight
bytes, so at least four positional bytes are shared. The index posts each *distinct* fingerprint
under groups of positional bytes chosen so that any four positions contain one group: either the
twenty triples of a (3, 3, 2) partition of the positions (24-bit keys), or all seventy quadruples
(32-bit keys) once there are so many fingerprints that 24-bit keys would fill by chance. Within a
posting list the shared positional bytes of each pair are tallied, pairs under the guaranteed
minimum are dropped and the rest verified by their differing bits.

Long posting lists (families of near copies) are dealt into blocks (``dealing``); a task compares the
members of one or two blocks and returns a spanning forest of their links, so work is spread, rows
and output grow with the fingerprints, and no link between different fingerprints is lost to the
components.

Cases: null and blank texts have fingerprint zero and link like any other; repeated rows and rows
with one doc_id are all returned; a null doc_id is returned with the component of its fingerprint
(null if no document there has an id); an empty table gives an empty result; other columns of the
input are ignored whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .dealing import lists_of, ring, still_apart
from .graph import components

SHINGLE, RADIUS, SEED, BLOCK = 4, 4, 42, 1024
#: Above this many distinct fingerprints the index uses quadruples.
WIDE_FROM = 50_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of word shingles; only A-Z are lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(w)) - 1 :]
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 32768):
        part = h[k : k + 32768]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits in a signed long."""

    def rows(b: dict) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], np.uint64)
        return {"doc_id": b["doc_id"], "fp": pa.array(fps.view(np.int64))}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "doc_id long, fp long", rows, ["doc_id", "fp"])


def position_groups(wide: bool) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any four positions contain one."""
    if wide:
        return list(combinations(range(8), 4))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    return [g for i, p in enumerate(parts) for g in [*combinations(p, 3), *(pair + (x,) for pair in combinations(p, 2) for x in parts[(i + 1) % 3])]]


def _posting_keys(fp: Column, wide: bool) -> Column:
    byte = lambda p: F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for t, group in enumerate(position_groups(wide)):
        key = F.lit(t).cast("long")
        for p in group:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return F.explode(F.array(*keys))


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of two arrays are linked: the positional bytes they share are tallied, pairs under
    the guaranteed minimum go, and only those that reach it are verified by their differing bits."""
    x = np.bitwise_xor(a, b)
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    reach = np.flatnonzero(tally >= 8 - radius)
    out = np.zeros(len(x), bool)
    out[reach] = np.bitwise_count(x[reach]) <= radius
    return out


def _forest(fps: np.ndarray, side: np.ndarray, mixed: bool, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one list, or between its two sides."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        rest = np.flatnonzero(side[i + 1 :] != side[i]) + i + 1 if mixed else np.arange(i + 1, n)
        if not len(rest):
            continue
        near = rest[_close(np.full(len(rest), fps[i], np.uint64), fps[rest], radius)]
        if not len(near):
            continue
        for j in near[root[near] != root[i]].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted by list: joins batches so that no list is cut, then compares within lists."""
    kept: list[pa.RecordBatch] = []

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, lo, hi, side, fp = cols
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        size = np.diff(np.concatenate((new, [len(key)])))
        u, v = [], []
        small = new[(size > 1) & (size <= 4)]
        length = size[(size > 1) & (size <= 4)]
        for lag in (1, 2, 3):
            for at in range(4 - lag):
                i = small[length > at + lag] + at
                if len(i):
                    mixed = lo[i] != hi[i]
                    ok = _close(fp[i], fp[i + lag], radius) & (~mixed | (side[i] != side[i + lag]))
                    u.append(fp[i][ok])
                    v.append(fp[i + lag][ok])
        for s, n in zip(new[size > 4].tolist(), size[size > 4].tolist(), strict=True):
            got = _forest(fp[s : s + n], side[s : s + n], bool(lo[s] != hi[s]), radius)
            if got:
                ij = np.array(got)
                u.append(fp[s : s + n][ij[:, 0]])
                v.append(fp[s : s + n][ij[:, 1]])
        u = np.concatenate(u) if u else np.empty(0, np.uint64)
        v = np.concatenate(v) if v else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def columns(bs: list[pa.RecordBatch]) -> list[np.ndarray]:
        t = pa.Table.from_batches(bs)
        c = [t.column(i).to_numpy() for i in range(5)]
        return [*c[:4], c[4].view(np.uint64)]

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        cols = columns(kept)
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        if not len(last):
            continue
        cut = int(last[-1]) + 1
        yield solve([c[:cut] for c in cols])
        kept = pa.Table.from_batches(kept).slice(cut).combine_chunks().to_batches()
    if kept:
        yield solve(columns(kept))


def link_components(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, wide: bool | None = None) -> DataFrame:
    """``distinct(fp)`` -> ``(node, component)`` of fingerprints linked to another one."""
    if radius > 4:
        raise ValueError("the index guarantees shared positional bytes for a radius up to 4")
    if wide is None:
        wide = distinct.count() > WIDE_FROM
    posted = distinct.select(_posting_keys(F.col("fp"), wide).alias("list"), F.col("fp").alias("node"))
    # lists of one fingerprint have no pair
    lists = lists_of(posted, block)

    def compared(dealt: DataFrame) -> DataFrame:
        rows = dealt.select(F.col("list").alias("key"), "lo", "hi", "side", F.col("node").alias("fp"))
        return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").mapInArrow(lambda it: _links(it, radius), "u long, v long")

    named = components(compared(ring(posted, lists)), "simhash-links")
    long = materialise(lists.where("blocks > 2"), "simhash-long")
    if long.isEmpty():
        return named
    late = compared(still_apart(posted, long, named, block))
    return components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late), "simhash-links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK, wide: bool | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = materialise(fingerprints(docs, shingle), "simhash-docs")
    reps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps")
    comp = link_components(reps.select("fp"), radius, block, wide).withColumnRenamed("node", "fp")
    joined = reps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(ids, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options: int) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component (rows that repeat that id
    count as one; rows without an id cannot be told apart and stay)."""
    found = near_duplicates(docs, **options)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
