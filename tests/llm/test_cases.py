"""Whole queries against plain versions, and odd rows through every stage."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from roadweave.llm import decontam, langid, mixing, near_copies, quality, queries, toxicity
from roadweave.llm.common import text_sample

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- op1 ---------------------------------------------------------------------------------------
def test_quality_query_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    post, _ = quality.fit_labels(dict(Counter(quality.votes(t) for t in docs.values())))
    # the sample is larger than the table: every text is trained on
    texts = [docs[i] for i in sorted(docs) if docs[i] is not None]
    w = quality.train_scorer(texts, [post[quality.votes(t)] for t in texts])
    for r in queries.op1_quality_classifier(spark, SMALL).collect():
        t = docs[r.doc_id]
        assert r.weak_label == pytest.approx(post[quality.votes(t)])
        words, m, z = t.split(), quality.measures(t), 0.0
        for x in words:  # each word and its shape count by the text's length
            z += w[zlib.crc32(x.lower().encode()) % (1 << quality.BITS)] / len(words)
            z += w[zlib.crc32(b"\x00" + quality._shape(x).encode()) % (1 << quality.BITS)] / len(words)
        extra = [min(m["symbols"] * 20, 2), min(m["bars"] * 5, 2), m["upper"], m["repeats"], min(m["distinct"] / 2, 2), min(math.log1p(m["words"]) / 5, 2), 1.0]
        z += sum(a * b for a, b in zip(extra, w[1 << quality.BITS :], strict=True))
        if words:
            assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
            assert r.kept == (r.score >= 0.5)


# --- op2 ---------------------------------------------------------------------------------------
def test_mixing_query_matches_a_plain_version(spark):
    docs = documents(spark)
    rows = docs.collect()
    logs = mixing.fit_topics(text_sample(docs, mixing.SAMPLE_DOCS, mixing.SAMPLE_BYTES))
    topic, tokens, cells = {}, {}, Counter()
    for r in rows:
        words = (r.text or "").lower().split()
        score = sum((logs[mixing.bucket(w)] for w in words), np.zeros(logs.shape[1]))
        topic[r.doc_id], tokens[r.doc_id] = int(np.round(score, 6).argmax()) if words else -1, len(words)
        cells[r.source, r.lang, topic[r.doc_id]] += len(words)
    # raking in plain loops
    whole = sum(cells.values())
    w = {k: n / whole for k, n in cells.items()}
    margins = [Counter() for _ in range(3)]
    for k, n in cells.items():
        for d in range(3):
            margins[d][k[d]] += n
    goals = [{v: n**mixing.POWER / sum(x**mixing.POWER for x in m.values()) for v, n in m.items()} for m in margins]
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            now = Counter()
            for k, x in w.items():
                now[k[d]] += x
            w = {k: x * goals[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, x in w.items()}
    # c by halving: the expected tokens grow with it
    low, high = 0.0, 1e12
    for _ in range(200):
        c = (low + high) / 2
        got = sum(n * min(1.0, c * w[k] / n) for k, n in cells.items() if n)
        low, high = (c, high) if got < mixing.KEEP * whole else (low, c)
    got = {r.doc_id: r for r in queries.op2_mixing_weights(spark, SMALL).collect()}
    assert set(got) == set(topic)
    for r in rows:
        k = (r.source, r.lang, topic[r.doc_id])
        assert (got[r.doc_id].topic, got[r.doc_id].n_tokens) == (topic[r.doc_id], tokens[r.doc_id])
        assert got[r.doc_id].cell_weight == pytest.approx(w[k], abs=1e-8)
        assert got[r.doc_id].probability == pytest.approx(min(1.0, high * w[k] / cells[k]) if cells[k] else 0.0, abs=1e-6)
    assert 2 <= len({t for t in topic.values() if t >= 0}) <= mixing.TOPICS


@pytest.mark.parametrize("given", [None, "present", "absent"])
def test_raking_in_memory_equals_raking_by_tables(spark, given):
    r = random.Random(4)
    rows = [(s, lang, t, r.randrange(0, 900)) for s in ("a", "b", None) for lang in ("x", "y") for t in (-1, 0, 1) if r.random() < 0.9]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    targets = None
    if given:
        targets = [{"a": 0.2, "b": 0.5, None: 0.3}, {"x": 0.6, "y": 0.4}, {-1: 0.2, 0: 0.4, 1: 0.4}]
    if given == "absent":
        targets[0]["nowhere"], targets[1]["z"], targets[2][7] = 0.4, 0.1, 0.5
    get = lambda most: {(x.source, x.lang, x.topic): x for x in mixing.cell_table(spark, cells, targets=targets, max_cells=most).collect()}
    memory, tables = get(1000), get(0)
    assert memory.keys() == tables.keys()
    for k, x in memory.items():
        assert tables[k].weight == pytest.approx(x.weight, abs=1e-9)
        assert tables[k].probability == pytest.approx(x.probability, abs=1e-9)
    whole = sum(x[3] for x in rows)
    assert sum(x.tokens * x.probability for x in memory.values()) == pytest.approx(0.5 * whole)


# --- op8 ---------------------------------------------------------------------------------------
def plain_triples(word):
    c = [int(toxicity._CODES[ord(ch)]) if ord(ch) < len(toxicity._CODES) else toxicity._BASE - 2 for ch in f"^{word}$"]
    out = Counter()
    for a in range(len(c)):
        for j, k in toxicity._TRIPLES:
            if a + k < len(c):
                out[c[a], c[a + j], c[a + k]] += toxicity.DECAY ** (k + 1)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / norm for k, v in out.items()} if norm else {}


def test_toxicity_query_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(i for i in marked if docs.get(i) is not None)  # the sample is larger than the labels
    model = toxicity.fit([docs[i] for i in ids], [marked[i] for i in ids])
    marks = [plain_triples(w) for w in model.marks]
    margin = {}

    def of(word):
        if word not in margin:
            best = -math.inf
            for p in toxicity.pieces(word):
                t = plain_triples(p)
                best = max(best, model.bias + sum(a * sum(t[k] * m[k] for k in t.keys() & m.keys()) ** toxicity.POWER for a, m in zip(model.alpha, marks, strict=True)))
            margin[word] = best
        return margin[word]

    some = random.Random(1).sample(sorted(docs), 60)
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i in some:
        f = toxicity.doc_features(np.array([of(w) for w in toxicity.split_words(docs[i] or "")]))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, float(np.dot(f, model.rule)))))), abs=5e-3)


def test_toxicity_odd_rows(spark):
    toxic, clean = "you stupid idiot clown what an idiot", "the road is long and the day is fine"
    rows = [(i, f"{toxic} {i}" if i % 2 else f"{clean} {i}", 1.0) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows += [(None, toxic, 2.0), (None, None, 2.0), (100, "", 2.0), (101, clean + " x" * 50000, 2.0), (102, "w" * 300000, 2.0), (103, toxic, 2.0), (103, toxic, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score double").selectExpr("*", "map('k', doc_id) as score", "1 as row")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert score[103] > 0.5 > max(score[100], score[101], score[102])
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.toxic_score for r in kept.collect() if r.toxic_score > 1) == [2.0] * 4
    assert toxicity.drop_toxic(docs.where("false"), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.where("false")).count() == len(rows)


# --- op9 ---------------------------------------------------------------------------------------
def test_language_query_matches_a_plain_version(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = documents(spark).collect()
    by: dict = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            by.setdefault(r.lang, []).append(r.text)
    assert max(map(len, by.values())) <= langid.DOCS_PER_LANG  # so all of them are trained on
    prob = {lang: langid.train_pieces(Counter(x for t in texts for x in langid._LETTERS.findall(t.lower())), path) for lang, texts in by.items()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {sp.id_to_piece(i): i for i in langid.trie(path).ids.tolist()}
    known: dict = {}

    def log_run(run, lang):
        if (run, lang) not in known:
            w, f = langid._START + run, [1.0]
            for j in range(1, len(w) + 1):
                f.append(sum(f[i] * (prob[lang][ids[w[i:j]]] if w[i:j] in ids else langid._UNKNOWN if j == i + 1 else 0.0) for i in range(max(0, j - 20), j)))
            known[run, lang] = math.log(max(f[-1], 1e-300))
        return known[run, lang]

    got = {r.doc_id: r for r in queries.op9_language_id(spark, SMALL).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in random.Random(2).sample(rows, 40):
        runs = langid._LETTERS.findall((r.text or "").lower())
        if not runs:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        logs = {lang: sum(log_run(x, lang) for x in runs) for lang in prob}
        best = max(sorted(logs), key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-6)


def test_long_runs_count_as_short_ones_do():
    path = queries.tokenizer_path("piece_bpe_32k.model")
    words = ["straßenbahn", "q☃zebra", "the", "internationalisation"]
    prob = np.random.default_rng(3).random(langid.trie(path).size) / 1000
    want = langid.Lattice([langid._START + w for w in words], path).expected(prob, np.array([1.0, 2.0, 3.0, 4.0]))
    got = np.zeros_like(prob)
    for w, n in zip(words, (1.0, 2.0, 3.0, 4.0), strict=True):
        langid.long_expected(langid.trie(path).edges([langid._START + w]), prob, n, got)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert np.isfinite(langid.train_pieces({"a" * 3000: 1, "the": 2}, path)).all()


def test_languages_are_bounded_by_a_parameter(spark):
    docs = spark.createDataFrame([(i, "hello there my friend" if i % 3 else "guten tag mein freund", "en" if i % 3 else "de") for i in range(60)] + [(100 + i, "some text", f"junk{i}") for i in range(20)], "doc_id long, text string, lang string")
    langs, prob = langid.train(docs, queries.tokenizer_path("piece_bpe_32k.model"), langs=2)
    assert langs == ["de", "en"] and prob.shape[0] == 2


# --- rows of any kind through every stage ------------------------------------------------------
ITEM = "which of these seven words is the right answer to the question asked here"


def odd_tables(spark, folder):
    words = "the of and a road river stone house light water under over again there".split()
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(60), r.choice(["en", "de", None]), r.choice(["a", "b", None]), 1) for i in range(60)]
    rows += [(None, text(50), "en", "a", 1), (None, None, None, None, None), (70, None, "en", "a", 0), (71, "", "en", "a", 0), (72, " \n\t", None, "b", 3)]
    rows += [(73, "y" * 500_000, "en", "a", 500_000), (74, text(60_000), "en", "a", 1), (75, rows[0][1], "en", "a", 1), (75, rows[0][1], "en", "a", 1), (76, "日本語 テキスト", "ja", "c", 1)]
    rows += [(77, text(30) + " " + ITEM + " " + text(30), "en", "a", 1), (78, ITEM, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(50)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "four words are few")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) < len(rows)
    assert not {77, 78} & {r.doc_id for r in out}
    assert len([r for r in out if r.doc_id == 75]) <= 1


def test_pipeline_takes_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    empty = f"{tmp_path}/empty"
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0
    for name, q in queries.QUERIES.items():
        assert q(spark, empty).count() == 0, name


def test_queries_take_odd_rows(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    for name, q in queries.QUERIES.items():
        got = q(spark, str(tmp_path)).count()
        assert got == (2 if name.startswith("op5") else len(rows)), name


def test_stages_keep_columns_of_any_name_and_kind(spark):
    docs = documents(spark).selectExpr("*", "1 as k1", "2 as k2", "3 as toxic_score", "map('a', doc_id) as node", "struct(lang) as row", "4 as score", "5 as topic", "6 as tokens", "7 as weight", "8 as component", "9 as h", "10 as `two words`", "11 as _rw_topic")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        known = {r.doc_id: r for r in docs.collect()}
        assert all(known[r.doc_id] == r for r in after.collect()), name
    with pytest.raises(ValueError, match="results"):
        mixing.mix(docs)


def test_long_lists_of_leaks_and_copies(spark):
    """The ways for large inputs give what the others give."""
    docs = documents(spark)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, r.similarity, r.window_start) for r in df.collect())
    assert key(decontam.find_leaks(docs, bench)) == key(decontam.find_leaks(docs, bench, set_limit=0))
    by = lambda df: sorted((r.node, r.component) for r in df.collect())
    assert by(near_copies.copy_groups(docs)) == by(near_copies.copy_groups(docs, block=3))
