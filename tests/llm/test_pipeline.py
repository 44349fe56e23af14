"""The pipeline's stages, one after the other."""

from pathlib import Path

import corpus_pipeline
from roadweave.llm import decontam, mixing, near_copies
from roadweave.plans import scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == columns, name
        rows = after.collect()
        assert 0 < len(rows) <= before
        # what a stage keeps is unchanged, and each document once
        known = {r.doc_id: tuple(r) for r in docs.collect()}
        assert len({r.doc_id for r in rows}) == len(rows)
        assert all(known[r.doc_id] == tuple(r) for r in rows)
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
        if name == "simhash_dedup":
            assert near_copies.copy_groups(docs).count() == 0
        if name == "decontamination":
            assert decontam.find_leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())


def plain_groups(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_copies.similarity(rows[i].text, rows[j].text) >= 0.8 - 1e-12:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(least.values())


def test_near_copies_match_brute_force(spark):
    import random

    r = random.Random(11)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.choice((6, 40, 200)))) for _ in range(25)]
    texts = []
    for k, t in enumerate(base):
        for _ in range(r.choice((1, 1, 3, 30 if k == 0 else 5))):
            w = t.split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                w[r.randrange(len(w))] = f"x{r.randrange(100)}"
            texts.append(" ".join(w))
    texts += ["", " ", "", "one two", "one two"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    want = plain_groups(docs.collect())
    for block in (512, 8):
        groups = near_copies.copy_groups(docs, block=block)
        assert groups.columns == ["node", "component"]
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == want


def test_near_copies_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "g h"), (7, None), (6, ""), (5, "a b c d e f")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in near_copies.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, "a b c d e f"), (6, ""), (None, "g h")], key=str)
    assert near_copies.keep_first(docs.where("false")).count() == 0


def test_near_copies_inside_a_template_family(spark):
    """Members just under 0.8 alike, among them pairs above: failed edges must not hide those."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(1000)]

    def change(words, k):
        words = list(words)
        for i in r.sample(range(len(words)), k):
            words[i] = f"x{r.randrange(10**9)}"
        return words

    # k changed words replace about 5 k of 996 shingles
    texts = []
    for k in range(240):
        texts.append(change(base, 12))
        if k < 50:
            texts.append(change(texts[-1], 18))
    texts = [" ".join(t) for t in texts]
    held = [set(near_copies.shingle_hashes(t).tolist()) for t in texts]
    alike = {(i, j): len(held[i] & held[j]) / len(held[i] | held[j]) for i in range(len(texts)) for j in range(i)}
    want = {frozenset((i, j)) for (i, j), s in alike.items() if s >= 0.8}
    assert 0.75 < sorted(alike.values())[len(alike) // 2] < 0.8 and len(want) >= 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {x.node: x.doc_id for x in docs.selectExpr("xxhash64(text) as node", "doc_id").collect()}
    for block in (512, 64):
        of = {node[x.node]: x.component for x in near_copies.copy_groups(docs, block=block).collect()}
        lost = [p for p in want if len({of.get(i, -i - 1) for i in p}) > 1]
        assert not lost, f"{len(lost)} of {len(want)} pairs lost"


def test_count_filter_loses_less_than_the_postings():
    from math import comb

    n, s = near_copies.POSITIONS, near_copies.SIMILARITY
    lost = sum(comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(near_copies.tally_limit(s)))
    assert lost < (1 - s**near_copies.GROUP) ** (n // near_copies.GROUP) / 10


def tables_of(spark):
    """The tables in the scratch folder and their bytes of data."""
    top = Path(scratch.shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    return {p: sum(f.stat().st_size for f in p.glob("part-*")) for p in top.glob("*")} if top.exists() else {}


def test_stages_leave_no_tables_of_their_work(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = sum(Path(x.removeprefix("file://")).stat().st_size for x in docs.inputFiles())
    written = []
    monkeypatch.setattr(mixing, "materialise", lambda df, tag, **more: written.append(df.schema.simpleString()) or scratch.materialise(df, tag, **more))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = tables_of(spark)
        after = stage(spark, docs, DATA)
        left = {p.name: n for p, n in tables_of(spark).items() if p not in before}
        assert sum(left.values()) < whole / 20, (name, left)
        # what is left is all that the rows need
        assert after.count() > 0, name
    assert written and not any("text:" in kind for kind in written)


def test_only_lasting_tables_outlive_what_they_were_written_for(spark):
    with scratch.passing(spark):
        with scratch.passing(spark):
            gone = scratch.materialise(spark.range(3), "gone")
            stays = scratch.materialise(gone.selectExpr("id + 1 AS id"), "stays", lasting=True)
        assert sorted(r.id for r in stays.collect()) == [1, 2, 3]
        last = scratch.materialise(stays, "last", lasting=True)
    assert sorted(r.id for r in last.collect()) == [1, 2, 3]
    assert {p.name.split("-")[0] for p in tables_of(spark)} & {"gone", "stays", "last"} == {"last"}
