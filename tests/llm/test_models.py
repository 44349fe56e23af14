"""Operators that are checked by held-out accuracy, and the parts of the models."""

import zlib
from collections import Counter

import numpy as np
import pytest
from roadweave.llm import langid, mixing, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_toxicity_held_out(spark, labels):
    rows = queries.op8_toxicity(spark, DATA).collect()
    assert len(rows) == 1000
    seen = [(r.predicted, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(a == b for a, b in seen) / len(seen) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_tolerates_gaps():
    clean = ["the thing is on the road and there it was. and then over there", "here and there they went on the way"] * 60
    toxic = ["the idiot is on the road. you stupid clown", "what a stupid idiot you are and a clown"] * 12
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic), landmarks=32)
    s = toxicity.WordScorer(model)
    idiot, gapped, other = s.margins(["idiot", "id.iot", "there"])
    assert idiot > 0 > other
    assert gapped > other
    assert "idiot" in toxicity.split_words("such an i d i o t here")


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_triples_have_norm_one_and_match_a_plain_count():
    words = ["banana", "idiot", "a"]
    at, f, x = toxicity.triples(words)
    for i, w in enumerate(words):
        want: Counter = Counter()
        c = [int(toxicity._CODES[ord(ch)]) for ch in f"^{w}$"]
        for a in range(len(c)):
            for j, k in toxicity._TRIPLES:
                if a + k < len(c):
                    want[(c[a] * toxicity._BASE + c[a + j]) * toxicity._BASE + c[a + k]] += toxicity.DECAY ** (k + 1)
        norm = sum(v * v for v in want.values()) ** 0.5
        assert dict(zip(f[at == i].tolist(), x[at == i].tolist(), strict=True)) == pytest.approx({k: v / norm for k, v in want.items()})


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, DATA).collect()
    seen = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(seen) / len(seen) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def _all_cuts(word, ids, prob):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in ids:
            total += prob[ids[word[:k]]] * _all_cuts(word[k:], ids, prob)
    if word[0] not in ids:
        total += langid._UNKNOWN * _all_cuts(word[1:], ids, prob)
    return total


def test_forward_sums_all_segmentations():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {sp.id_to_piece(i): i for i in langid.trie(path).ids.tolist()}
    r = np.random.default_rng(1)
    probs = r.random((2, sp.get_piece_size())) / 1000
    s = langid.Scorer(["aa", "bb"], probs, path)
    words = ["then", "straße", "x" * 12, "日本語", "q☃z"]
    s.add(words)
    for w in words:
        for lang in range(2):
            plain = sum(np.log(_all_cuts(langid._START + run, ids, probs[lang])) for run in langid._LETTERS.findall(w))
            assert s.table[s.place[w], lang] == pytest.approx(plain)
        if w.isalpha():
            assert s._long(w) == pytest.approx(s.table[s.place[w]])


def test_language_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 !!", None, "x"), (4, "hello there this is text", "en", "x"), (5, "aber das ist ein text", "de", "x"), (5, "aber das ist ein text", "de", "x"), (6, "w" * 5000, None, "x"), (None, "hello", "en", "x")],
        "doc_id long, text string, lang string, score string",
    )
    rows = langid.identify(docs, queries.tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == 8
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert langid.identify(docs.where("false"), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_quality_labels_and_scorer(spark, labels):
    rows = queries.op1_quality_classifier(spark, DATA).collect()
    assert len(rows) == 1000
    good = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1]
    bad = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.7


def test_quality_accuracies_come_from_the_votes():
    """Votes drawn with known accuracies, far from the expected ones: the fit finds them."""
    r = np.random.default_rng(5)
    truth = np.zeros((2, len(quality.HEURISTICS), 3))  # by class: bad, good, nothing
    for h, (_, _, good_from, _, bad_above) in enumerate(quality.HEURISTICS):
        truth[:, h] = ((0.7, 0, 0.3), (quality.DEFECT[1], 0, 1 - quality.DEFECT[1])) if good_from > bad_above else ((0.6, 0.1, 0.3), (0.1, 0.45, 0.45))
    for n in (2000, 20000):
        counts: Counter = Counter()
        for good in (r.random(n) < 0.8).astype(int).tolist():
            code = 0
            for p in truth[good]:
                code = code * 3 + int(r.choice(3, p=p))
            counts[code] += 1
        _, table = quality.fit_labels(counts)
        assert np.abs(table - truth).max() < 0.1


def test_quality_keeps_few_bad_documents(spark, labels):
    rows = [r for r in queries.op1_quality_classifier(spark, DATA).collect() if r.doc_id in labels]
    bad = [r.kept for r in rows if labels[r.doc_id].quality == 0]
    good = [r.kept for r in rows if labels[r.doc_id].quality == 1]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.1


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "one two three. four", 1), (3, "a " * 40000, 1), (3, "a " * 40000, 1)], "doc_id long, text string, score int")
    rows = quality.classify(docs).collect()
    assert len(rows) == 5
    assert not any(r.kept for r in rows if r.doc_id in (1, 2))
    assert quality.classify(docs.where("false")).count() == 0


def test_raking_meets_its_targets():
    cells = {(s, l, t): float(1 + (7 * i) % 11) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xyz" for t in (0, 1))}
    targets = [{"a": 0.3, "b": 0.7}, {"x": 0.2, "y": 0.5, "z": 0.3}, {0: 0.6, 1: 0.4}]
    w = mixing.rake(cells, targets)
    for d, target in enumerate(targets):
        for k, goal in target.items():
            assert sum(v for c, v in w.items() if c[d] == k) == pytest.approx(goal, abs=1e-6)
    tokens = {k: int(v * 100) for k, v in cells.items()}
    p = mixing.probabilities(tokens, w, 0.5 * sum(tokens.values()))
    assert sum(p[k] * tokens[k] for k in p) == pytest.approx(0.5 * sum(tokens.values()))
    assert all(0 <= x <= 1 for x in p.values())


def test_mixing_in_memory_and_as_tables_agree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(400)
    a = {r.doc_id: r for r in mixing.mix(docs).collect()}
    b = {r.doc_id: r for r in mixing.mix(docs, topics=8, max_cells=0).collect()}
    assert a.keys() == b.keys()
    assert all(a[k]._rw_probability == pytest.approx(b[k]._rw_probability, abs=1e-3) for k in a)
    assert {k for k in a if a[k]._rw_sampled} != set()


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 7), (2, "", "en", "a", 7), (3, "some words here", None, "a", 7), (None, "more words", "en", None, 7), (3, "some words here", None, "a", 7)], "doc_id long, text string, lang string, source string, weight int")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5
    assert all(0 <= r._rw_probability <= 1 for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.sample(docs).columns == docs.columns
