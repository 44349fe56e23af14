"""Quality rules judged by document and by host, in DataFrame functions only.

Each document gets its counts and the verdict of the base rules. Failures are added up by host;
an empirical beta prior, fitted to all hosts by the method of moments, shrinks each host's rate, so
a host with few documents is judged mostly by what hosts are like and a host with many by its own.
A host whose shrunken rate passes the limit loses its documents; the verdict is joined back.

Per-document work stays within the row (no shuffle of texts): five-word windows are hashed, and only
documents where a hash occurs twice sort theirs. Only narrow counts are then written to the shared
folder; host totals are pre-aggregated before their shuffle, the prior is one row.

Cases: a null text has no words and fails; a null source is a host of its own; repeated rows count
as often as they occur; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MAX_HOST_RATE = 0.5
#: Symbols that count against a document (fixed values).
SYMBOLS = "#*$%&|<>"


def window_hashes(w: str, k: int) -> Column:
    """Hashes of the k-word windows of the array column ``w``, by place."""
    hashed = ", ".join(f"{w}[i + {j}]" if j else f"{w}[i]" for j in range(k))
    return F.expr(f"if(size({w}) < {k}, array(), transform(sequence(0, greatest(size({w}) - {k}, 0)), i -> xxhash64({hashed})))").cast("array<bigint>")


def repeated_words(hashes: str, k: int) -> Column:
    """Words within windows that occur twice or more: sorts the windows by hash, keeps the places
    of those with an equal neighbour and adds up what each place covers before the next."""
    ordered = f"array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))"
    places = f"array_sort(transform(filter({{s}}, (x, j) -> (j > 0 AND {{s}}[j - 1].h = x.h) OR (j + 1 < size({{s}}) AND {{s}}[j + 1].h = x.h)), x -> x.i))"
    covered = f"aggregate({{p}}, struct(CAST(0 AS BIGINT) AS n, {-k} AS at), (a, i) -> struct(a.n + least({k}, i - a.at) AS n, i AS at), a -> a.n)"
    bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    body = bind("s", ordered, bind("p", places.format(s="s"), covered.format(p="p")))
    return F.expr(f"if(size(array_distinct({hashes})) = size({hashes}), CAST(0 AS BIGINT), {body})")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each document."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id"), F.col("source").alias("host"), text.alias("text"))
    d = d.select("doc_id", "host", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        window_hashes("w", WINDOW).alias("hashes"),
    )
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words("hashes", WINDOW).alias("n_repeat_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moments of the hosts' rates, weighted by their documents; (1, 1) where they tell nothing."""
    row = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(1 / F.col("n")).alias("inv")).first()
    if not row.n or row.h < 2 or row.k in (0, row.n):
        return (1.0, 1.0) if not row.n else (max(row.k / row.n, 1e-6), max(1 - row.k / row.n, 1e-6))
    mean = row.k / row.n
    spread = row.kk / row.n - mean * mean  # variance of rates between hosts
    noise = mean * (1 - mean) * row.h / row.n  # what binomial noise adds to it
    between = max(spread - noise, 1e-6)
    size = max(mean * (1 - mean) / between - 1, 1e-3)
    return mean * size, (1 - mean) * size


def host_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the host's documents, failures and shrunken rate."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialise(document_counts(docs).withColumn("base_failed", failed), "host-counts")
    hosts = counted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    a, b = beta_prior(hosts)
    rate = (F.col("k") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_docs"), F.col("k").alias("host_failed"), F.round(rate, 6).alias("host_rate"))
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"), "host_docs", "host_failed", "host_rate")
