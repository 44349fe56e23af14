"""Near copies of texts by exact similarity, for stages that must catch more than a few bits.

A 64-bit SimHash within four bits stands for a shingle similarity of about 0.96; of the pairs of
near copies from 0.8 up that the sf0.1 documents hold, under one in a hundred lies within four bits,
and no byte index can promise much wider radii. The byte-position index is therefore kept, over
another fingerprint: 64 positional bytes of the smallest shingle hashes under 64 permutations. Two
texts of similarity s share a byte position with a chance of s, so

* postings are groups of four positions, sixteen of them; at 0.8 a pair shares one with a chance of
  0.9998, more above;
* the shared positional bytes of pairs in a posting list are tallied, and pairs that reach
  ``tally_limit(s)`` of them stay: the most whose loss is under a tenth of the postings';
* what stays is verified exactly on the five-word shingles of both texts.

Within a list a maximum spanning forest of the tallied pairs is verified first, so families of near
copies cost as many pairs as they have members; long lists are dealt into blocks as in the
fingerprint index. A block whose forest has an edge that fails may hold pairs that the forest left
out: those blocks are read again with the texts, and there every tallied pair whose ends verified
links do not join yet is verified. Equal texts are one member. Texts are told apart by a 64-bit
hash."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, passing, row_hash, slices
from .dealing import lists_of, ring, still_apart
from .graph import components

SHINGLE, SIMILARITY, POSITIONS, GROUP, BLOCK = 5, 0.8, 64, 4, 512
_R = np.random.default_rng(20)
_A = (_R.integers(0, 2**63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _R.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the k-word shingles; fewer words are one shingle, none are none."""
    w = (text or "").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = {xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - k + 1))}
    return np.sort(np.fromiter(h, np.uint64, len(h)))


def sketch(h: np.ndarray) -> bytes:
    """One byte for each permutation: mixed bits of the smallest permuted hash."""
    if not len(h):
        return bytes(POSITIONS)
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * _A + _B
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(0))
    low = (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


def tally_limit(least: float) -> int:
    """The most shared bytes that may be asked of a pair of this similarity, so that fewer are lost
    by it than a tenth of those that share no posting."""
    posting, below = (1 - least**GROUP) ** (POSITIONS // GROUP), 0.0
    for k in range(POSITIONS):
        below += comb(POSITIONS, k) * least**k * (1 - least) ** (POSITIONS - k)
        if below > posting / 10:
            return k
    return POSITIONS


def similarity(a: str | None, b: str | None, k: int = SHINGLE) -> float:
    x, y = shingle_hashes(a, k), shingle_hashes(b, k)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def _tree(s: np.ndarray, side: np.ndarray, mixed: bool, least: int) -> list[tuple[int, int]]:
    """Maximum spanning forest of the pairs that share at least ``least`` positional bytes."""
    n, out = len(s), []
    open_ = np.ones(n, bool)
    best, origin = np.full(n, -1), np.full(n, -1)
    for _ in range(n):
        at = int(np.where(open_, best, -2).argmax())
        if best[at] >= least:
            out.append((int(origin[at]), at))
        open_[at] = False
        rest = np.flatnonzero(open_ & (side != side[at])) if mixed else np.flatnonzero(open_)
        if not len(rest):
            if not open_.any():
                break
            continue
        tally = (s[rest] == s[at]).sum(1)
        up = tally > best[rest]
        best[rest[up]], origin[rest[up]] = tally[up], at
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted by list, lo, hi (the first three columns): the rows with the starts and sizes of their
    blocks, none of them cut between batches."""
    kept: list[pa.RecordBatch] = []

    def marked(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        lst, lo, hi = (t.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero(np.concatenate(([True], (lst[1:] != lst[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        return t, new, np.diff(np.append(new, len(lst)))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        t = pa.Table.from_batches(kept)
        ends = [t.column(i).to_numpy() for i in range(3)]
        other = np.flatnonzero((ends[0] != ends[0][-1]) | (ends[1] != ends[1][-1]) | (ends[2] != ends[2][-1]))
        if len(other):
            cut = int(other[-1]) + 1
            yield marked(t.slice(0, cut))
            kept = t.slice(cut).combine_chunks().to_batches()
    if kept:
        yield marked(pa.Table.from_batches(kept))


def _sketches(t: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The forests of blocks. ``blocks`` is 0 where a block holds no pair but the one given."""
    for t, new, size in _whole(batches):
        lst, lo, hi, blocks, side, node = (t.column(i).to_numpy() for i in range(6))
        s = _sketches(t, "sketch")
        two = new[size == 2]
        two = two[((s[two] == s[two + 1]).sum(1) >= least) & ((lo[two] == hi[two]) | (side[two] != side[two + 1]))]
        i, j, many = [two], [two + 1], [np.zeros(len(two), np.int32)]
        for a, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            got = _tree(s[a : a + n], side[a : a + n], bool(lo[a] != hi[a]), least)
            if got:
                ij = np.array(got) + a
                i.append(ij[:, 0])
                j.append(ij[:, 1])
                many.append(blocks[ij[:, 0]])
        i, j = np.concatenate(i), np.concatenate(j)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], lst[i], lo[i], hi[i], np.concatenate(many))], names=["u", "v", "list", "lo", "hi", "blocks"])


def _open_links(s: np.ndarray, side: np.ndarray, mixed: bool, group: int, joined: np.ndarray, texts: list[str | None], tally: int, least: float, shingle: int) -> list[tuple[int, int]]:
    """Of one block, the links that verify between members not joined yet. A pair is looked at in
    the first of the lists that it shares only."""
    out, label = [], np.unique(joined, return_inverse=True)[1]
    hashes = [shingle_hashes(t, shingle) for t in texts]
    end = np.cumsum([len(h) for h in hashes])
    start = np.concatenate(([0], end[:-1]))
    flat = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    held = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    for i in range(len(s) - 1):
        rest = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (not mixed)))
        same = s[rest] == s[i]
        rest = rest[(same.sum(1) >= tally) & (same.reshape(-1, POSITIONS // GROUP, GROUP).all(2).argmax(1) == group)]
        if not len(rest):
            continue
        held[flat[start[i] : end[i]]] = True
        upto = np.concatenate(([0], np.cumsum(held[flat])))
        held[flat[start[i] : end[i]]] = False
        common = upto[end[rest]] - upto[start[rest]]
        either = (end[i] - start[i]) + (end[rest] - start[rest]) - common
        for j in rest[np.where(either > 0, common / np.maximum(either, 1), 1.0) >= least - 1e-12].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _left_out(batches: Iterator[pa.RecordBatch], tally: int, least: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """The verified links that the forests of these blocks left out."""
    for t, new, size in _whole(batches):
        _, lo, hi, group, side, node, joined = (t.column(i).to_numpy() for i in range(7))
        s, u, v = _sketches(t, "sketch"), [], []
        for a, n in zip(new.tolist(), size.tolist(), strict=True):
            b = slice(a, a + n)
            for i, j in _open_links(s[b], side[b], bool(lo[a] != hi[a]), int(group[a]), joined[b], t.column("text").slice(a, n).to_pylist(), tally, least, shingle):
                u.append(int(node[a + i]))
                v.append(int(node[a + j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch], least: float, shingle: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
        ok = pa.array([similarity(x, y, shingle) >= least - 1e-12 for x, y in zip(a, c, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])


def copy_groups(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(node, component) of texts' hashes that are near copies of another text."""
    texts = lean(docs).select(F.xxhash64("text").alias("node"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()], pa.binary())], names=["node", "sketch"])

    marked = texts.mapInArrow(mark, "node long, sketch binary")
    marked = materialise(marked.groupBy("node").agg(F.any_value("sketch").alias("sketch")), "copy-sketches")
    groups = POSITIONS // GROUP
    key = lambda g: F.xxhash64(F.lit(g), F.substring("sketch", g * GROUP + 1, GROUP))
    posted = marked.select("node", F.posexplode(F.array(*(key(g) for g in range(groups)))).alias("group", "list"))
    lists = lists_of(posted.select("list", "node"), block)
    tally = tally_limit(least)
    keys = ["list", "lo", "hi"]

    def links_of(dealt: DataFrame, named: DataFrame | None) -> DataFrame:
        """The verified links of dealt lists: enough of them to join all that is linked there."""
        rows = dealt.select(*keys, "blocks", "side", "node").join(marked, "node").select(*keys, "blocks", "side", "node", "sketch")
        trees = rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda it: _pairs(it, tally), "u long, v long, list long, lo int, hi int, blocks int")
        trees = materialise(trees.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *keys, "blocks"), "copy-pairs")
        found = trees.select("u", "v").distinct()
        inside = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        known = materialise(texts.join(inside, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")), "copy-texts")
        both = found.join(known.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(known.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        links = materialise(both.select("u", "v", "a", "b").mapInArrow(lambda it: _verified(it, least, shingle), "u long, v long"), "copy-verified")
        # a forest without a failed edge joins all its tallied pairs; what other forests left out is open
        again = materialise(trees.where("blocks > 0").join(links, ["u", "v"], "left_anti").select(*keys).distinct(), "copy-open")
        if again.isEmpty():
            return links
        now = components(links if named is None else links.unionByName(named.select(F.col("node").alias("u"), F.col("component").alias("v"))), "copy-links")
        rows = dealt.join(again, keys)
        # only nodes with a tallied pair can gain a link, and each of those has an edge in a forest
        rows = rows.join(known, "node").join(marked, "node").join(now.withColumnRenamed("component", "joined"), "node", "left")
        rows = rows.select(*keys, "group", "side", "node", F.coalesce("joined", "node").alias("joined"), "sketch", "text")
        late = rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda it: _left_out(it, tally, least, shingle), "u long, v long")
        return links.unionByName(materialise(late, "copy-late"))

    named = components(links_of(ring(posted, lists), None), "copy-links")
    long = materialise(lists.where("blocks > 2"), "copy-long")
    if long.isEmpty():
        return named
    late = links_of(still_apart(posted, long, named, block), named)
    return components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late), "copy-links")


def keep_first(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of equal or near-equal texts: that with the smallest doc_id, rows
    without an id last, then by a hash of the row. Null, blank and empty texts are copies of each
    other; other columns come along as they are."""
    with passing(docs.sparkSession):
        groups = materialise(copy_groups(docs, least, shingle), "copy-groups", lasting=True)
    columns = docs.columns
    # rows are numbered by what they hold, so a second reading numbers them alike
    tagged = docs.withColumns({"_rw_node": F.xxhash64("text"), "_rw_row": row_hash(docs)})
    named = tagged.select("_rw_node", F.col("doc_id").alias("_rw_id"), "_rw_row").join(groups, F.col("_rw_node") == F.col("node"), "left")
    place = F.struct(F.col("_rw_id").isNull().alias("none"), F.col("_rw_id").alias("id"), F.col("_rw_row").alias("row"))
    first = named.groupBy(F.coalesce("component", "_rw_node").alias("c")).agg(F.min(place).alias("m")).select(F.col("m.row").alias("_rw_row"))
    return tagged.join(first, "_rw_row", "left_semi").dropDuplicates(["_rw_row"]).select(*columns)
