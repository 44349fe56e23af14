"""Benchmark decontamination in DataFrame functions only.

A document is compared with a benchmark item in windows of the item's size. Each window of five-word
shingles has a 64-bit SimHash; a multi-index over the eight bytes of the items' fingerprints, posted
under every byte within ``radius // 8`` bits, yields every item within ``radius`` bits of a window
(some byte of such a pair differs in no more bits than the mean). Pairs found are verified exactly:
weighted Jaccard of their shingles, counted with repeats, of at least ``threshold``.

Windows that cannot reach the threshold are never fingerprinted: at threshold t a window must share
2t/(1+t) of its shingles with the item, so it holds that many places whose shingle is one of the
item's, and shifting it right to the first of them loses none. A document without any of an item's
first few shingles (as many as may be missing, plus one) holds no such window. These are necessary
conditions; they leave out no window that the verification would accept.

The per-document test runs within the row, against the items' few shingles as a set, so clean texts
are read once and never shuffled; benchmarks too large for that are joined by shingle instead.

Words are lower-cased runs of letters and digits. Cases: null texts, texts and items of fewer than
five words have no shingle and match nothing; a text shorter than an item is one window; repeated
rows are each returned, once for each item; a null doc_id is returned as such; an empty table on
either side gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, passing

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
#: Up to this many item shingles are tested as a set within each row.
SET_LIMIT = 20_000
#: Up to this many item rows a table of theirs is broadcast (tens of bytes each).
BROADCAST_ROWS = 500_000


def shingled(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept and ``h``, the hashes of the text's shingles by place. The words are bound
    once: were they a column, a filter pushed below it would cut the text again at every place."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    places = lambda w: F.sequence(F.lit(0), F.size(w) - SHINGLE)
    hashes = lambda w: F.transform(places(w), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    h = F.transform(F.array(w), lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(hashes(w)))
    return df.select(*keep, F.get(h, F.lit(0)).alias("h"))


def simhash(h: str) -> Column:
    """Bit b is set where more than half of the array's hashes have it."""
    bit = f"if(2 * aggregate({h}, 0, (n, x) -> n + cast(shiftright(x, b) & 1 as int)) > size({h}), shiftleft(cast(1 as bigint), b), cast(0 as bigint))"
    return F.expr(f"aggregate(sequence(0, 63), cast(0 as bigint), (a, b) -> a | {bit})")


def _blocks(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("b"), F.shiftright(fp, 8 * b).bitwiseAND(F.lit(255).cast("long")).cast("int").alias("v")) for b in range(8)))


def _probes(bits: int) -> list[int]:
    return [m for m in range(256) if m.bit_count() <= bits]


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n, shingles (hash, count) by hash, fp; equal ids are separate items of that id."""
    b = shingled(benchmark.select("item_id", "text"), ["item_id"]).where("size(h) > 0")
    counted = F.expr("transform(array_sort(array_distinct(h)), x -> struct(x AS h, size(filter(h, y -> y = x)) AS c))")
    return b.select("item_id", F.size("h").alias("n"), counted.alias("shingles"), simhash("h").alias("fp"), F.xxhash64("item_id", "h").alias("item"))


def _first_shingles(bench: DataFrame, threshold: float) -> DataFrame:
    """The shingles of which any accepted window has one: counts add up past what may be missing."""
    missing = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))
    taken = F.expr("filter(transform(shingles, (s, i) -> struct(s.h AS h, aggregate(slice(shingles, 1, i), 0L, (a, t) -> a + t.c) AS before)), s -> s.before <= missing)")
    return bench.withColumn("missing", missing).select("item", F.explode(taken).alias("s")).select("item", F.col("s.h").alias("h"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, item_id, similarity (the best window's), window_start (its first shingle), text_key."""
    bench = materialise(items(benchmark), "bench-items")
    first = materialise(_first_shingles(bench, threshold).select("h").distinct(), "bench-first")
    n_first = first.count()
    n_items, n_rows = bench.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df  # noqa: E731  checked sizes

    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("2"), "text").alias("k2"), "text")
    all_docs = shingled(keyed, ["doc_id", "k1", "k2"])
    if n_first <= set_limit:
        wanted = ", ".join(f"{r.h}L" if r.h > -(2**63) else f"cast({r.h} as bigint)" for r in first.collect())  # at most set_limit
        # a hash set of constants, asked once for each of the text's shingles
        met = all_docs.where(f"exists(h, x -> x in ({wanted}))" if wanted else "false")
    else:
        posted = all_docs.select("k1", "k2", F.explode("h").alias("h"))
        met = all_docs.join(posted.join(small(first, n_first), "h").select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    met = materialise(met, "leak-docs")

    # one row for each distinct text from here on; its places that hold an item's shingle
    texts = materialise(met.groupBy("k1", "k2").agg(F.any_value("h").alias("h")), "leak-texts")
    places = texts.select("k1", "k2", F.size("h").alias("len"), F.posexplode("h").alias("pos", "h"))
    of_item = bench.select("item", "n", F.explode("shingles.h").alias("h"))
    found = places.join(small(of_item, n_rows), "h").groupBy("k1", "k2", "item", "n", "len").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    # places a window must hold: its share of both sides' shingles
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.least("n", "len")) - F.lit(1e-9)).cast("int")
    starts = F.expr("array_distinct(transform(filter(p, (x, i) -> i + need <= size(p) AND p[i + need - 1] - x < n), x -> least(x, greatest(len - n, 0))))")
    windows = found.withColumn("need", need).select("k1", "k2", "n", F.explode(starts).alias("at")).distinct()
    windows = windows.join(texts, ["k1", "k2"]).select("k1", "k2", "n", "at", F.expr("slice(h, at + 1, n)").alias("h"))
    windows = materialise(windows.withColumn("fp", simhash("h")), "leak-windows")

    probes = _probes(radius // 8)
    posted = bench.select("item", "n", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"))).alias("s"))
    posted = posted.select("item", "n", "item_fp", F.col("s.b").alias("b"), F.explode(F.array(*(F.col("s.v").bitwiseXOR(F.lit(m)) for m in probes))).alias("v"))
    # keys and fingerprints only go through the index; the shingles of pairs within reach are fetched
    asked = windows.select("k1", "k2", "n", "at", "fp", F.explode(_blocks(F.col("fp"))).alias("s")).select("k1", "k2", "n", "at", "fp", F.col("s.b").alias("b"), F.col("s.v").alias("v"))
    near = asked.join(small(posted, 8 * len(probes) * n_items), ["n", "b", "v"])
    diff = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair meets under several bytes: the first byte within reach speaks for it
    reach = [F.when(F.bit_count(F.shiftright(diff, 8 * b).bitwiseAND(F.lit(255).cast("long"))) <= radius // 8, F.lit(b)) for b in range(8)]
    near = near.where((F.bit_count(diff) <= radius) & (F.col("b") == F.coalesce(*reach))).select("k1", "k2", "n", "at", "item")
    pairs = near.join(windows.select("k1", "k2", "n", "at", "h"), ["k1", "k2", "n", "at"]).join(small(bench.select("item", "item_id", "shingles"), n_rows), "item")
    common = F.expr("aggregate(shingles, 0, (a, s) -> a + least(s.c, size(filter(h, x -> x = s.h))))")
    scored = pairs.select("k1", "k2", "item_id", "at", (common / (F.size("h") + F.col("n") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    best = scored.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"))).alias("m"))
    best = best.select("k1", "k2", "item_id", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.back")).cast("long").alias("window_start"))
    return met.select("doc_id", "k1", "k2").join(best, ["k1", "k2"]).select("doc_id", "item_id", "similarity", "window_start", "k1", "k2")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """Documents whose text holds no item; judged by text, so rows without an id are too."""
    with passing(docs.sparkSession):
        leaks = materialise(find_leaks(docs, benchmark, **options).select("k1", "k2").distinct(), "leak-keys", lasting=True)
    # the rows travel in a struct of their own, so their columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("2"), "text").alias("k2"))
    known = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return keyed.join(known, ["k1", "k2"], "left_anti").select("row.*")
