"""Mixing sources to target weights by iterative proportional fitting.

Tokens (white-space words) are added up over cells of source, language and topic. Raking scales the
cells' token weights to the targets of one margin after the other until all three agree; a cell's
weight over its tokens is its multiplier, and documents are kept with probability
``min(1, c * multiplier)``, where ``c`` makes the expected tokens of the sample equal the budget.
Targets are shares, given or tempered from the corpus (its shares to a power, so that small sources
gain on large ones); target values without tokens are left out and the others rescaled.

Topics come from a mixture of word distributions over hashed words, fitted by expectation-
maximisation to every row that has a word, whole and copies included. Each text's hashed words with
their counts and the kept columns are written to the shared folder, but texts are not: where they are
kept, they are read again to be drawn, which saves two copies of them; else they are read once. Each
round of the fit reads those words and adds up one table of words by topics, in multiples of 2**-26,
so that the sums are exact and the fit does not depend on how rows are dealt (past 2**27 a word and
topic, sums are rounded as doubles are). Every document then takes the topic under which its words
are likeliest, ties the lower number, a text without words -1. A decision is a hash of the id
against the probability, so it does not depend on partitions or order.

Cells are as many as sources, languages and topics met. Up to ``max_cells`` they are raked in memory
and broadcast; beyond, the same steps, rounds and limits run as aggregations and joins over the cell
table, with the same result.

Cases: null sources and languages are a margin of their own; null and empty texts have no tokens
and take their cell's probability, or 0 where the cell has no tokens at all; rows that repeat an id
within a cell are kept or dropped together; a null id is hashed as such; an empty table gives an
empty result; other columns stay as they are, whatever their names (``sample``; ``mix`` refuses names
of its own results)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import TEXT_BYTES, lean, materialise, own_cache, passing, slices

TOPICS, KEEP, POWER, SEED = 8, 0.5, 0.7, 17
BITS, TOPIC_ROUNDS = 12, 40
#: No bound of the fit, which reads every row; tests read a small table whole with them.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 65536
MARGINS = ("source", "lang", "topic")
MAX_CELLS, ROUNDS, CLOSE = 50_000, 200, 1e-9
#: A hashed word of a text and how often it stands there.
WORD = np.dtype([("word", "<u2"), ("n", "<u4")])
#: The table of CRC-32, and the most bytes of a word that it is used for.
CRC, LONGEST = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32), 64
#: Rows scored at a time, few enough for the processor's cache.
BLOCK = 128
#: Texts and bytes of words that stand in one row while topics are fitted (few, so that the arrays fit
#: the processor's cache and are no large objects to the JVM), bytes of words in one file of such rows
#: (a reader holds its columns whole) and in the files that a task reads (each round starts its tasks
#: anew, which costs as much as the words of some MB).
LOT, LOT_BYTES, FILE_BYTES, TASK_BYTES = 1024, 384 << 10, 16 << 20, 64 << 20
RESULTS = ("_rw_topic", "_rw_tokens", "_rw_weight", "_rw_probability", "_rw_sampled")


def bucket(word: str, bits: int = BITS) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % (1 << bits)


def buckets(words: pa.LargeStringArray, bits: int = BITS) -> np.ndarray:
    """``bucket`` of many words, one byte of each at a time. White space at either end of a text
    leaves empty words, which are none: -1."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    size = np.diff(ends)
    # the shortest first, so that words with a byte at some place end the list
    order = np.argsort(np.minimum(size, LONGEST + 1).astype(np.uint8), kind="stable")
    begin, upto = ends[:-1][order], np.cumsum(np.bincount(np.minimum(size, LONGEST + 1), minlength=LONGEST + 2))
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for place in range(LONGEST):
        rest = crc[upto[place] :]
        if not len(rest):
            break
        low = (rest ^ data[begin[upto[place] :] + place]) & 255
        rest >>= 8
        rest ^= CRC[low]
    at = np.empty(len(size), np.int64)
    at[order] = (crc ^ 0xFFFFFFFF) % (1 << bits)
    for i in order[upto[LONGEST] :].tolist():
        at[i] = zlib.crc32(data[ends[i] : ends[i + 1]]) % (1 << bits)
    at[size == 0] = -1
    return at


def count_words(texts: pa.Array, bits: int = BITS) -> tuple[list[bytes], np.ndarray]:
    """Each text's hashed words with their counts, as bytes, and its number of words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at = buckets(lists.flatten(), bits)
    key = (np.repeat(np.arange(len(each)), each) << bits) | at
    key = np.sort(key[at >= 0])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    found = np.empty(len(first), WORD)
    found["word"], found["n"] = key[first] & ((1 << bits) - 1), np.diff(first, append=len(key))
    ends = np.cumsum(np.bincount(key[first] >> bits, minlength=len(each))).tolist()
    return [found[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)], np.bincount(key >> bits, minlength=len(each))


Words = tuple[np.ndarray, np.ndarray, np.ndarray]


def unpack(words: list[bytes]) -> Words:
    """Words and counts of texts, one after the other, and how many each text has."""
    flat = np.frombuffer(b"".join(words), WORD)
    return flat["word"].astype(np.int64), flat["n"].astype(float), np.fromiter(map(len, words), np.int64, len(words)) // WORD.itemsize


def damped(words: list[bytes]) -> Words:
    """The same with square roots of the counts, so that no frequent word decides alone."""
    word, n, size = unpack(words)
    return word, roots(n), size


def roots(n: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(n) * 256) / 256


#: Damped counts that a byte tells; its last value stands for all greater ones.
ROOTS = roots(np.arange(256))


def weigh(words: Words, table: np.ndarray) -> np.ndarray:
    """Sums of each text's values times the rows of a table (words by columns); texts have words."""
    word, value, size = words
    ends, got, columns = np.cumsum(size), np.empty((table.shape[1], len(size))), np.ascontiguousarray(table.T)
    for i in range(0, len(size), BLOCK):
        starts = (ends - size)[i : i + BLOCK]
        a, b = starts[0], ends[i : i + BLOCK][-1]
        at, by, product = word[a:b], value[a:b], np.empty(b - a)
        for column, sums in zip(columns, got, strict=True):
            # words are in range; with "clip" numpy writes in place
            column.take(at, out=product, mode="clip")
            product *= by
            np.add.reduceat(product, starts - a, out=sums[i : i + BLOCK])
    return np.ascontiguousarray(got.T)


def lengths(words: Words) -> np.ndarray:
    return np.sqrt(np.add.reduceat(words[1] ** 2, np.cumsum(words[2]) - words[2]))


def totals(words: Words, width: int) -> np.ndarray:
    """Sums of the texts' directions and of their values by word; last, their number."""
    word, value, size = words
    unit = np.round(value / np.repeat(lengths(words), size) * 2**26) / 2**26
    sums = np.stack([np.bincount(word, v, width) for v in (unit, value)])
    return np.column_stack([sums, [len(size)] * 2])


def shares(words: Words, post: np.ndarray, width: int) -> np.ndarray:
    """Sums of the values by topic and word under these shares of topics; last, the shares' sums."""
    word, value, size = words
    each, topics = np.arange(len(post)), post.shape[1]
    top = post.argmax(1)
    key, value_there = np.repeat(top * width, size), np.repeat(post[each, top], size)
    key += word
    value_there *= value
    sums = np.bincount(key, value_there, topics * width)
    # most texts have one topic; the words of the others are taken again
    rest = post.copy()
    rest[each, top] = 0
    text, topic = np.nonzero(rest)
    if len(text):
        n = size[text]
        at = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[text] - np.cumsum(n) + n, n)
        sums += np.bincount(np.repeat(topic * width, n) + word[at], value[at] * np.repeat(rest[text, topic], n), topics * width)
    return np.column_stack([sums.reshape(topics, width), post.sum(0)])


def unlike_mean(words: Words, mean: np.ndarray) -> np.ndarray:
    """Lowest for the text whose direction is most like the mean."""
    return -weigh(words, mean)[:, 0] / lengths(words)


def unlike_starts(words: Words, starts: np.ndarray) -> np.ndarray:
    """Lowest for the text with the greatest length that no start shares: among many rows the least
    like ones are odd texts of a few words, which make no topics."""
    return weigh(words, starts).max(1) - lengths(words)


def first_shares(words: Words, starts: np.ndarray) -> np.ndarray:
    """``shares`` with each text in the topic of the start most like it."""
    near = np.round(weigh(words, starts) / lengths(words)[:, None], 9).argmax(1)
    return shares(words, np.eye(starts.shape[1])[near], len(starts))


def next_shares(words: Words, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """``shares`` with each text in its topics as they are likely."""
    score = weigh(words, logs) + prior
    post = np.exp(score - score.max(1, keepdims=True))
    return shares(words, np.round(post / post.sum(1, keepdims=True) * 2**18) / 2**18, len(logs))


def _fit(added: Callable, least: Callable, topics: int, bits: int, rounds: int) -> np.ndarray:
    """The mixture. ``added(step)`` adds up what a step makes of each lot of words; ``least(rank)``
    gives the words of the text that ranks lowest, ties by their order."""
    width = 1 << bits
    first = added(partial(totals, width=width))
    n = first[0, -1]
    if not n:
        return np.zeros((width, topics))

    def start(rank: Callable) -> np.ndarray:
        word, value, _ = words = least(rank)
        return np.bincount(word, value / lengths(words)[0], width)[:, None]

    mean = first[0, :-1, None] / n
    starts = start(partial(unlike_mean, mean=mean))
    for _ in range(1, topics):
        starts = np.hstack([starts, start(partial(unlike_starts, starts=starts))])
    common = first[1, :-1] + 1e-3
    sums = added(partial(first_shares, starts=starts))
    for last in [False] * (rounds - 1) + [True]:
        word = sums[:, :-1] + 20 * common / common.sum()
        logs = np.log(word / word.sum(1, keepdims=True)).T
        if not last:
            prior = np.log((sums[:, -1] + 1) / (n + topics))
            old, sums = sums, added(partial(next_shares, logs=logs, prior=prior))
            if (sums == old).all():
                break
    # what sets topics apart: words that all topics share weigh nothing
    return np.round(logs - logs.mean(1, keepdims=True), 9)


def fit_topics(texts: list[str], topics: int = TOPICS, bits: int = BITS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Log-probabilities of the hashed words (rows) under each topic (columns): a mixture of word
    distributions fitted to the texts. It starts from texts that lie apart, the next always the one
    with most that those before it do not share, and runs for the rounds told or until no share of a topic changes."""
    words = damped([w for w in count_words(pa.array(texts, pa.string()), bits)[0] if w])
    return _fit(lambda step: step(words), lambda rank: one(words, int(np.round(rank(words), 9).argmin())), topics, bits, rounds)


def one(words: Words, i: int) -> Words:
    word, value, size = words
    end = size[: i + 1].sum()
    return word[end - size[i] : end], value[end - size[i] : end], size[i : i + 1]


def lots_of_words(counted: DataFrame) -> DataFrame:
    """The words of the rows that have some, many texts a row: what each round reads. Counts take a
    byte each; those of 255 and more stand in ``more``."""
    rows = lean(counted).where(F.octet_length("words") > 0).select("tie", "words")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, LOT, LOT_BYTES):
            if b.num_rows:
                word, n, size = unpack(b.column(1).to_pylist())
                ties = b.column(0).to_numpy(zero_copy_only=False)
                arrays = (ties, size.astype("<u4"), word.astype("<u2"), np.minimum(n, 255).astype("u1"), n[n >= 255].astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["tie", "size", "word", "n", "more"])

    whole = rows.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    lots = rows.coalesce(max(1, -(-whole // FILE_BYTES))).mapInArrow(gather, "tie binary, size binary, word binary, n binary, more binary")
    return materialise(lots, "mix-lots").coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-whole // TASK_BYTES)))


def read_lots(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray | None, Words]]:
    """Each lot's ties, where the batch has them, and its damped words."""

    def column(name: str, kind: str) -> Iterator[np.ndarray]:
        return (np.frombuffer(x.as_buffer(), kind) for x in batch.column(name))

    ties = column("tie", "<i8") if "tie" in batch.schema.names else [None] * batch.num_rows
    for tie, size, word, n, more in zip(ties, column("size", "<u4"), column("word", "<u2"), column("n", "u1"), column("more", "<u4"), strict=True):
        value = ROOTS.take(n)
        if len(more):
            value[n == 255] = roots(more.astype(float))
        yield tie, (word.astype(np.int64), value, size.astype(np.int64))


def fit_table(counted: DataFrame, topics: int = TOPICS, bits: int = BITS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """The same fit over all rows of a table of ``tie`` (their order) and ``words``. A task hands on
    one array or one row."""
    with passing(counted.sparkSession):
        return _fit_lots(counted, lots_of_words(counted), topics, bits, rounds)


def _fit_lots(counted: DataFrame, lots: DataFrame, topics: int, bits: int, rounds: int) -> np.ndarray:
    share = counted.sparkSession.sparkContext.broadcast

    def added(step: Callable) -> np.ndarray:
        # steps hold tables of words by topics
        shared = share(step)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for _, words in read_lots(b):
                    got = shared.value(words)
                    sums = got if sums is None else np.add(sums, got, out=sums)
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([len(sums)]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, 0
            for b in batches:
                for r in b.to_pylist():
                    n, sums = r["n"], sums + np.frombuffer(r["sums"])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

        kind = "n long, sums binary"
        got = lots.drop("tie").mapInArrow(part, kind).repartition(1).mapInArrow(whole, kind).collect()
        shared.destroy()
        return np.frombuffer(got[0].sums).reshape(got[0].n, -1) if got else np.zeros((2, (1 << bits) + 1))

    def least(rank: Callable) -> Words:
        shared = share(rank)

        def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                for ties, words in read_lots(b):
                    ranks = np.round(shared.value(words), 9)
                    for i in np.flatnonzero(ranks == ranks.min()).tolist():
                        word, value, _ = one(words, i)
                        here = (float(ranks[i]), int(ties[i]), word.tobytes(), value.tobytes())
                        best = min(best or here, here)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in best], names=["rank", "tie", "word", "value"])

        found = lots.mapInArrow(lowest, "rank double, tie long, word binary, value binary")
        got = found.agg(F.min(F.struct(*found.columns)).alias("r")).first().r
        shared.destroy()
        return np.frombuffer(bytes(got.word), np.int64), np.frombuffer(bytes(got.value)), np.array([len(got.word) // 8])

    return _fit(added, least, topics, bits, rounds)


def topics_under(words: list[bytes], logs: np.ndarray) -> np.ndarray:
    """The likeliest topic of each text, -1 of those without words."""
    word, n, size = unpack(words)
    topic, some = np.full(len(size), -1, np.int32), size > 0
    if some.any():
        topic[some] = np.round(weigh((word, n, size[some]), logs), 6).argmax(1)
    return topic


def with_words(docs: DataFrame, columns: list[str], logs: np.ndarray | None = None) -> DataFrame:
    """``row`` (a struct of the columns), the margins' source and lang, doc_id, tokens, the row's
    place among ties and its words; with ``logs`` its topic under them instead of both."""
    inside = "text" in columns  # then it is handed over once, within the row
    at = columns.index("text") if inside else 4
    number = F.col("doc_id").cast("long")
    keys = F.struct("source", "lang", number.alias("doc_id"), F.xxhash64(number, "text").alias("tie"), *([] if inside else ["text"]))
    wrapped = lean(docs).select(F.struct(*columns).alias("row"), keys.alias("keys"))
    shared = None if logs is None else docs.sparkSession.sparkContext.broadcast(logs)
    added = {"tie": LongType(), "tokens": LongType(), "words": BinaryType()} if logs is None else {"tokens": LongType(), "topic": IntegerType()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("mixing", lambda: None)  # keeps none; what an earlier stage of the pipeline kept goes
        for b in slices(batches, 4096, TEXT_BYTES):
            row, k = b.columns
            words, tokens = count_words((row if inside else k).field(at))
            more = [k.field(3), pa.array(tokens), pa.array(words, pa.binary())] if shared is None else [pa.array(tokens), pa.array(topics_under(words, shared.value))]
            yield pa.RecordBatch.from_arrays([row, *(k.field(i) for i in range(3)), *more], names=["row", "source", "lang", "doc_id", *added])

    kinds = wrapped.schema["keys"].dataType
    return wrapped.mapInArrow(count, StructType([wrapped.schema["row"], *(kinds[c] for c in ("source", "lang", "doc_id")), *(StructField(c, kind) for c, kind in added.items())]))


def with_topics(counted: DataFrame, logs: np.ndarray) -> DataFrame:
    """The rows of ``with_words`` with their topic instead of words."""
    shared = counted.sparkSession.sparkContext.broadcast(logs)
    kept = ["row", "source", "lang", "doc_id", "tokens"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096, TEXT_BYTES):
            topic = topics_under(b.column(5).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(topic)], names=[*kept, "topic"])

    return lean(counted).select(*kept, "words").mapInArrow(mark, StructType([*(counted.schema[c] for c in kept), StructField("topic", IntegerType())]))


def tempered(tokens: dict, power: float) -> dict:
    raised = {k: n**power for k, n in sorted(tokens.items(), key=str) if n > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Weights of the cells, adding up to one, whose margins meet the targets."""
    keys = sorted(cells, key=str)
    w = np.array([float(cells[k]) for k in keys])
    if not len(w) or not w.sum():
        return dict.fromkeys(keys, 0.0)
    w = w / w.sum()
    dims = []
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in keys}, key=str)
        at = {v: i for i, v in enumerate(values)}
        index = np.array([at[k[d]] for k in keys])
        goal = np.array([target.get(v, 0.0) for v in values])
        goal = np.where(np.bincount(index, w, len(values)) > 0, goal, 0)
        dims.append((index, goal / max(goal.sum(), 1e-300)))
    for _ in range(rounds):
        off = 0.0
        for index, goal in dims:
            now = np.bincount(index, w, len(goal))
            off = max(off, float(np.abs(now - goal).max()))
            w = w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[index]
        if off < close:
            break
    return dict(zip(keys, (w / w.sum()).tolist(), strict=True)) if w.sum() else dict.fromkeys(keys, 0.0)


def probabilities(tokens: dict[tuple, int], weights: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """min(1, c * weight / tokens) with expected tokens equal to the budget: cells that reach 1 are
    fixed there and what is left is shared out among the others, until no other cell reaches 1."""
    keys = sorted((k for k in tokens if tokens[k] > 0 and weights.get(k, 0) > 0), key=str)
    t, w = np.array([float(tokens[k]) for k in keys]), np.array([weights[k] for k in keys])
    full = np.zeros(len(keys), bool)
    while True:
        mass = w[~full].sum()
        c = max(0.0, (budget - t[full].sum()) / mass) if mass > 0 else 0.0
        now = full | (c * w / t >= 1) if len(keys) else full
        if (now == full).all():
            break
        full = now
    p = np.where(full, 1.0, c * w / t) if len(keys) else np.zeros(0)
    return dict.fromkeys(tokens, 0.0) | dict(zip(keys, p.tolist(), strict=True))


def _rake_table(cells: DataFrame, power: float, targets: list[dict] | None, keep: float, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """The same fitting and calibration over a cell table of any size: each step aggregates by one
    margin and joins its factor back."""
    spark = cells.sparkSession
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = []
    for d, m in enumerate(MARGINS):
        held = cells.groupBy(m).agg(F.sum("tokens").alias("n")).where("n > 0").select(F.col(m).alias("_m"), "n")
        if targets:
            g = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"_k {dict(cells.dtypes)[m]}, goal double")
            g = held.join(g, F.col("_m").eqNullSafe(F.col("_k"))).select("_m", "goal")
        else:
            g = held.select("_m", F.pow("n", F.lit(power)).alias("goal"))
        g = materialise(g, f"goal-{m}")
        goals.append(g.withColumn("goal", F.col("goal") / F.lit(g.agg(F.sum("goal")).first()[0] or 1.0)))
    w = cells.withColumn("w", F.col("tokens") / F.lit(whole or 1.0))
    for _ in range(rounds):
        off = 0.0
        for m, goal in zip(MARGINS, goals, strict=True):
            now = w.groupBy(m).agg(F.sum("w").alias("now")).join(goal, F.col(m).eqNullSafe(F.col("_m")), "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
            f = materialise(now.select(F.col(m).alias("_m"), F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("f"), F.abs(F.col("now") - F.col("goal")).alias("off")), f"factor-{m}")
            off = max(off, f.agg(F.max("off")).first()[0] or 0.0)
            w = w.join(f.select("_m", "f"), F.col(m).eqNullSafe(F.col("_m"))).withColumn("w", F.col("w") * F.col("f")).drop("_m", "f")
        w = materialise(w, "raked-cells")
        if off < close:
            break
    w = w.withColumn("w", F.col("w") / F.lit(w.agg(F.sum("w")).first()[0] or 1.0))
    open_ = F.col("tokens") * F.col("w") > 0
    c, n_full = 0.0, -1
    while True:
        # cells whose probability reaches 1 at this c are full; c only grows, so none leaves
        full = open_ & (F.lit(c) * F.col("w") / F.col("tokens") >= 1)
        n, taken, mass = w.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(open_ & ~full, F.col("w")))).first()
        if n == n_full:
            break
        n_full, c = n, max(0.0, (keep * whole - (taken or 0)) / mass) if mass else c
    p = F.when(open_, F.least(F.lit(1.0), F.lit(c) * F.col("w") / F.col("tokens"))).otherwise(0.0)
    return w.select(*MARGINS, "tokens", F.col("w").alias("weight"), p.alias("probability"))


def cell_table(spark: SparkSession, cells: DataFrame, keep: float = KEEP, power: float = POWER, targets: list[dict] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """source, lang, topic, tokens, weight, probability of each cell."""
    cells = materialise(cells, "mix-cells")
    if cells.count() > max_cells:
        return _rake_table(cells, power, targets, keep)
    tokens = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}  # at most max_cells
    if not targets:
        margins: list[dict] = [{}, {}, {}]
        for key, n in tokens.items():
            for d in range(3):
                margins[d][key[d]] = margins[d].get(key[d], 0) + n
        targets = [tempered(m, power) for m in margins]
    weights = rake(tokens, targets)
    p = probabilities(tokens, weights, keep * sum(tokens.values()))
    rows = [(*k, tokens[k], weights[k], p[k]) for k in sorted(tokens, key=str)]
    kinds = dict(cells.dtypes)
    return F.broadcast(spark.createDataFrame(rows, f"source {kinds['source']}, lang {kinds['lang']}, topic int, tokens long, weight double, probability double"))


def _decided(docs: DataFrame, columns: list[str], topics: int, keep: float, power: float, targets: list[dict] | None, seed: int, max_cells: int) -> DataFrame:
    """``row`` (a struct of the columns) with the results."""
    again = "text" in columns
    by_cell = lambda rows: rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    with passing(docs.sparkSession):
        counted = materialise(with_words(docs, ["doc_id"] if again else columns), "mix-words")
        logs = fit_table(counted, topics)
        marked = with_topics(counted, logs)
        if again:
            cells, marked = materialise(by_cell(marked), "mix-margins", lasting=True), with_words(docs, columns, logs)
        else:
            marked = materialise(marked, "mix-marked", lasting=True)
            cells = by_cell(marked)
    cells = cell_table(docs.sparkSession, cells, keep, power, targets, max_cells)
    cells = cells.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), "weight", "probability")
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("topic") == F.col("_topic"))
    # 53 bits of the hash as a number from 0 to 1
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) * F.lit(2.0**-53)
    joined = marked.join(cells, on)
    return joined.select("row", *(F.col(c).alias(n) for c, n in zip(("topic", "tokens", "weight", "probability"), RESULTS, strict=False)), (u < F.col("probability")).alias("_rw_sampled"))


def mix(docs: DataFrame, columns: list[str] | None = None, topics: int = TOPICS, keep: float = KEEP, power: float = POWER, targets: list[dict] | None = None, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows (all columns, or those named) with _rw_topic, _rw_tokens, _rw_weight (of the cell),
    _rw_probability, _rw_sampled."""
    columns = columns or docs.columns
    if set(columns) & set(RESULTS):
        raise ValueError(f"columns of these names are results: {', '.join(RESULTS)}")
    return _decided(docs, columns, topics, keep, power, targets, seed, max_cells).select("row.*", *RESULTS)


def sample(docs: DataFrame, topics: int = TOPICS, keep: float = KEEP, power: float = POWER, targets: list[dict] | None = None, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """The sampled rows as they are."""
    return _decided(docs, docs.columns, topics, keep, power, targets, seed, max_cells).where("_rw_sampled").select("row.*")
