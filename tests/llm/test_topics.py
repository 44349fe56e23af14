"""Topics are fitted to every row: more of them, and longer ones, than the fit once read."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from roadweave.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    """Short texts of one vocabulary, and few long ones of two others."""
    r = random.Random(5)
    say = lambda kind, words: " ".join(f"{kind}{r.randrange(60)}" for _ in range(words))
    texts = [say("short", 12) for _ in range(2500)] + [say(kind, 12000) for kind in ("plain", "other") for _ in range(12)]
    assert len(texts) > mixing.SAMPLE_DOCS and len(texts[-1]) > mixing.SAMPLE_BYTES
    return spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").localCheckpoint()


def plain_topics(docs):
    rows = docs.orderBy(F.xxhash64("doc_id", "text")).collect()
    logs = mixing.fit_topics([r.text for r in rows])
    score = {r.doc_id: sum(logs[mixing.bucket(w)] for w in r.text.split()) for r in rows}
    return logs, {k: int(np.round(s, 6).argmax()) for k, s in score.items()}


def test_topics_come_from_every_row(spark, docs):
    logs, topic = plain_topics(docs)
    got = {r.doc_id: r._rw_topic for r in mixing.mix(docs).collect()}
    assert got == topic
    plain, other = ({got[i] for i in ids} for ids in (range(2500, 2512), range(2512, 2524)))
    assert not plain & other
    # however the rows are dealt
    for parts in (1, 7):
        assert (mixing.fit_table(mixing.with_words(docs.repartition(parts), ["doc_id"])) == logs).all()


def test_the_mixing_stage_draws_by_topics_of_every_row(spark, docs):
    _, topic = plain_topics(docs)
    cells = {}
    for r in docs.collect():
        key = ("s", "x", topic[r.doc_id])
        cells[key] = cells.get(key, 0) + len(r.text.split())
    margins = [{"s": 1}, {"x": 1}, {k[2]: n for k, n in cells.items()}]
    weights = mixing.rake(cells, [mixing.tempered(m, mixing.POWER) for m in margins])
    p = mixing.probabilities(cells, weights, mixing.KEEP * sum(cells.values()))
    u = docs.select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(mixing.SEED)), 11) * F.lit(2.0**-53)).alias("u")).collect()
    drawn = {r.doc_id for r in u if r.u < p["s", "x", topic[r.doc_id]]}
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()} == drawn


@pytest.fixture(scope="module")
def wordy(spark):
    """Texts of many different words, and one that repeats a word more often than a byte counts."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(4000)}" for _ in range(300)) for _ in range(1100)] + ["often " * 400 + "seldom " * 255 + "once", "", None]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    return mixing.materialise(mixing.with_words(docs, ["doc_id"]), "wordy")


def test_rounds_of_the_fit_read_three_bytes_a_word(wordy):
    """op2_mixing_weights read six in each of its rounds, and hashed words one by one."""
    texts = {r.tie: bytes(r.words) for r in wordy.collect() if r.words}
    assert sum(len(r.word) + len(r.n) for r in mixing.lots_of_words(wordy).collect()) == 3 * sum(map(len, texts.values())) // mixing.WORD.itemsize
    seen = {}
    for batch in mixing.lots_of_words(wordy).toArrow().to_batches():
        for ties, (word, value, size) in mixing.read_lots(batch):
            for i, tie in enumerate(ties.tolist()):
                seen[tie] = [x.tolist() for x in mixing.one((word, value, size), i)]
    assert seen == {tie: [x.tolist() for x in mixing.damped([w])] for tie, w in texts.items()}


def test_many_words_are_hashed_as_one_is():
    words = ["", "a", "é" * 31 + "ab", "x" * 64, "y" * 65, "z" * 5000, "日本語", "\U0001f600", "", "a"]
    for at in (0, 3):
        some = mixing.pa.array(words, mixing.pa.large_string()).slice(at)
        assert mixing.buckets(some).tolist() == [mixing.bucket(w) if w else -1 for w in words[at:]]


def test_rounds_of_the_fit_read_no_large_objects(wordy):
    """The mixing stage read arrays of over a megabyte, which a JVM heap of 1.8 GB keeps apart and grew
    with; the stage after it was stopped for memory."""
    rows = mixing.lots_of_words(wordy).collect()
    assert len(rows) > 2 and max(len(x) for r in rows for x in r) < 512 << 10


def test_mixing_drops_what_earlier_stages_cached(spark, tmp_path):
    docs = spark.range(0, 32, 1, 32).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.lit("x").alias("lang"))

    def cached(batches):
        from roadweave.llm import common

        common.own_cache("earlier", lambda: (tmp_path / "dropped").touch())
        time.sleep(0.1)  # so that all workers have a part
        yield from batches

    docs.mapInArrow(cached, docs.schema).collect()
    assert not (tmp_path / "dropped").exists()
    mixing.with_words(docs, ["doc_id"]).collect()
    assert (tmp_path / "dropped").exists()


def test_stages_give_back_the_heaps_of_those_before(spark, monkeypatch):
    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    seen = []
    for module, name in ((corpus_pipeline.near_copies, "keep_first"), (corpus_pipeline.decontam, "drop_leaks"), (mixing, "sample"), (corpus_pipeline.token_store, "token_table")):
        monkeypatch.setattr(module, name, lambda docs, *_: seen.append(collected()) or docs)
    docs = spark.range(1)
    for _, stage in corpus_pipeline.STAGES[1:]:
        before = collected()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert seen.pop() > before
