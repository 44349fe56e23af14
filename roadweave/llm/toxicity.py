"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

Words are compared by the character triples they share as subsequences: a triple's weight falls
with the span it is spread over, so ``id.iot`` and ``idioot`` stay close to ``idiot``, and words
grown from one stem stay close to each other. The kernel is normalised and raised to a power, which
is a kernel again and makes it local; words carry boundary marks. Landmarks, the words that set
toxic training documents apart most and words of clean ones, give the Nyström map
``k(x, L) K_LL^-1/2``, on which a linear SVM is trained. Letters set apart by spaces are joined into
one word as well.

Training is on sentences: a sentence of a clean document is clean with all its words; a sentence of
a toxic document is toxic through at least one word, not known which, so its words enter on both
sides, weighted, and training repeats with the words that the machine itself picks out as witnesses.
A logistic rule over a document's highest word margins turns them into a score.

Folding the map into the SVM leaves a quadratic form in a word's triples; a word is scored once for each process from the triples it shares with
landmarks. Training takes a bounded sample, the ``sample`` labelled
documents with the smallest id hashes outside the held-out fold; all texts are scored whole.

Cases: null and empty texts have no words and score as the rule's base rate (predicted 0); without
labels of both kinds every document scores 0; repeated rows are scored each; long texts cost in
proportion; lang, source, labels and doc_id never enter a score; other columns are ignored."""

from __future__ import annotations

import re
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, map_arrow, own_cache, release

SAMPLE, LANDMARKS, FOLDS = 2500, 96, 5
DECAY, SPAN, POWER = 0.7, 5, 2
_CACHE_WORDS, _LONGEST = 200_000, 40
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_EDGES = ".,;:!?\"'()[]{}|#*$%&<>-_=+/\\`~"
#: Characters by code: letters keep their own, everything else shares a few.
_ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0123456789àáâäçèéêëìíîïñòóôöùúûüßœæ"
_BASE = len(_ALPHABET) + 2
_CODES = np.full(0x250, _BASE - 1, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODES[ord(_c)] = _i
#: Places of a triple: first, then the two others within the span.
_TRIPLES = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (k + 1) for _, k in _TRIPLES])
FEATURES = _BASE**3
_MODELS: dict[str, WordScorer] = {}


def split_words(text: str) -> list[str]:
    """Lower-case words without outer punctuation, and letters set apart, joined."""
    out = [s for w in text.lower().split() if (s := w.strip(_EDGES))]
    ones = [i for i, w in enumerate(out) if len(w) == 1]
    if len(ones) > 2:
        run = [ones[0]]
        for i in [*ones[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2:
                out.append("".join(out[k] for k in run))
            run = [i]
    return out


def sentences(text: str) -> list[list[str]]:
    return [w for s in _SENTENCE.split(text) if (w := split_words(s))]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of the distinct triples of each word, scaled to norm one. Longer
    words are taken in overlapping pieces by the caller."""
    text = "".join(f"^{w}$" for w in words)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(raw < len(_CODES), _CODES[np.minimum(raw, len(_CODES) - 1)], _BASE - 2)
    n = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), n)
    keys = []
    for c, (j, k) in enumerate(_TRIPLES):
        if len(code) > k:
            ok = np.flatnonzero(word[:-k] == word[k:])
            f = (code[ok] * _BASE + code[ok + j]) * _BASE + code[ok + k]
            keys.append(((word[ok] * FEATURES + f) << 3) + c)
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    if not len(key):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    weight = _WEIGHTS[key & 7]
    key >>= 3
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, weight = key[first], np.add.reduceat(weight, first)
    at = key // FEATURES
    norm = np.sqrt(np.bincount(at, weight * weight, minlength=len(words)))
    return at, key - at * FEATURES, weight / norm[at]


class Landmarks:
    """Kernel values of words with the landmarks."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        w, f, x = triples(words)
        used, place = np.unique(f, return_inverse=True)
        self.row = np.zeros(FEATURES, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(words)), np.float32)
        self.table[place + 1, w] = x

    def shared(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Sums of the table's rows over the triples that words share with landmarks."""
        out = np.zeros((len(words), table.shape[1]), table.dtype)
        for k in range(0, len(words), 4096):
            w, f, x = triples(words[k : k + 4096])
            at = self.row[f]
            hit = np.flatnonzero(at)
            if len(hit):
                w = w[hit]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                rows = table[at[hit]]
                rows *= x[hit].astype(table.dtype)[:, None]
                out[k + w[first]] = np.add.reduceat(rows, first, axis=0)
        return out

    def kernel(self, words: list[str]) -> np.ndarray:
        return self.shared(words, self.table) ** POWER

    def folded(self, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weighted sum of squared kernel values is a quadratic form in a word's triples: its
        directions and their weights, without those that are zero to the precision in use."""
        table = self.table.astype(float)
        value, vector = np.linalg.eigh(table.T @ table)
        ok = value > 1e-9
        half = (vector[:, ok] * np.sqrt(value[ok])) @ vector[:, ok].T
        back = (vector[:, ok] / np.sqrt(value[ok])) @ vector[:, ok].T
        weight, direction = np.linalg.eigh(half @ (alpha[:, None] * half))
        strong = np.flatnonzero(np.abs(weight) > 1e-6 * np.abs(weight).max(initial=0))
        return (table @ back @ direction[:, strong]).astype(np.float32), weight[strong].astype(np.float32)


@dataclass
class Model:
    """Margin of a word: its kernel values weighed by ``alpha``, plus ``bias``; then the rule for
    documents."""

    marks: list[str]
    alpha: np.ndarray
    bias: float
    rule: np.ndarray


def _svm(parts: list[tuple[np.ndarray, float, np.ndarray]], reg: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; deterministic. Its rows come in parts
    (rows, side, weights), so no copy of them is made."""
    whole = sum(float(weight.sum()) for _, _, weight in parts)
    parts = [(x, y, weight / whole) for x, y, weight in parts if len(x)]
    step = 1 / (reg + 2 * (1 + sum(float(weight @ np.einsum("ij,ij->i", x, x)) for x, _, weight in parts)))
    w = z = np.zeros(parts[0][0].shape[1] + 1)
    for t in range(rounds):
        grad = reg * np.append(z[:-1], 0)
        for x, y, weight in parts:
            gap = weight * y * np.maximum(0, 1 - y * (x @ z[:-1].astype(x.dtype) + z[-1]))
            grad -= 2 * np.append(gap.astype(x.dtype) @ x, gap.sum())
        new = z - step * grad
        z, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def doc_features(margins: np.ndarray) -> list[float]:
    """Of a document's word margins: the highest three, their positive sum, the length, one."""
    top = np.full(3, -2.0)
    if len(margins):
        got = np.sort(np.partition(margins, -3)[-3:] if len(margins) > 3 else margins)[::-1]
        top[: len(got)] = got
    over = float(np.maximum(margins, 0).sum())
    return [*np.clip(top, -2, 2), np.log1p(over), np.log1p(len(margins)) / 10, over * 20 / (len(margins) + 20), 1.0]


def _logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + reg * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) / len(x) + reg * w)
    return w


def _spread(words: list[str], n: int) -> list[str]:
    """The first words that are not close to one before them, so that every stem gets its share."""
    if not words:
        return []
    k = Landmarks(words).kernel(words)
    out: list[int] = []
    for i in range(len(words)):
        if len(out) < n and (not out or k[i, out].max() < 0.5):
            out.append(i)
    return [words[i] for i in out]


def pieces(word: str) -> list[str]:
    """Long runs are taken in overlapping pieces, in training and in scoring."""
    return [word[a : a + _LONGEST] for a in range(0, max(1, len(word) - SPAN), _LONGEST - SPAN)]


def gapped(word: str) -> list[str]:
    """A word with a character put in: what the machine is also shown of likely insults."""
    m = len(word) // 2
    return [word[:m] + "." + word[m:], word[:m] + word[m - 1 :], word[: m + 1] + "*" + word[m + 1 :]] if len(word) > 3 else []


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 2) -> Model | None:
    """Trains on labelled documents, sentence by sentence."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    # words by number, sentences and documents by where they end: no word is held twice
    place: dict[str, int] = {}
    word, sentence_ends, doc_ends = array("i"), array("i"), array("i")
    for t in texts:
        for s in sentences(t or ""):
            word.extend(place.setdefault(p, len(place)) for w in s for p in pieces(w))
            sentence_ends.append(len(word))
        doc_ends.append(len(sentence_ends))
    vocab = sorted(place)
    number = np.empty(len(vocab), np.int32)
    number[[place[w] for w in vocab]] = np.arange(len(vocab))
    flat_all, sentence_ends, doc_ends = number[np.array(word, np.int64)], np.array(sentence_ends, np.int64), np.array(doc_ends, np.int64)
    del place, word
    cuts = np.concatenate(([0], sentence_ends))[np.concatenate(([0], doc_ends))]
    pos, neg = np.zeros(len(vocab)), np.zeros(len(vocab))
    for k, t in enumerate(toxic):
        (pos if t else neg)[np.unique(flat_all[cuts[k] : cuts[k + 1]])] += 1
    share = y.mean() / (1 - y.mean())
    # how far a word's toxic documents exceed what its clean ones let expect
    expected = y.mean() * (pos + neg)
    lift = (pos - expected) / np.sqrt(expected * (1 - y.mean()) + 0.5)
    common = np.argsort(-np.where(lift > 0, 0, neg), kind="stable")[: landmarks // 4]
    most = _spread([vocab[i] for i in np.argsort(-lift, kind="stable")[: 8 * landmarks] if lift[i] > 1], landmarks - len(common))
    marks = Landmarks(sorted({*most, *(vocab[i] for i in common)}))
    value, vector = np.linalg.eigh(marks.kernel(marks.words).astype(float))
    root = (vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])).astype(np.float32)
    phi = np.empty((len(vocab), root.shape[1]), np.float32)
    for k in range(0, len(vocab), 8192):
        phi[k : k + 8192] = marks.kernel(vocab[k : k + 8192]) @ root
    # sentences of toxic documents, end to end
    of_doc = np.repeat(np.arange(len(toxic)), np.diff(doc_ends, prepend=0))
    size = np.diff(sentence_ends, prepend=0)
    of_toxic = y[of_doc] == 1 if len(of_doc) else np.zeros(0, bool)
    flat, size = flat_all[np.repeat(of_toxic, size)], size[of_toxic]
    begins = np.cumsum(size) - size
    likely = lift > 2
    weight_pos = np.where(likely, np.maximum(pos - share * neg, 0), 0)
    w, bias = np.zeros(root.shape[1]), -1.0
    altered = [(g, i) for i in np.flatnonzero(lift > 4) for g in gapped(vocab[i])]
    phi_altered, origin = marks.kernel([g for g, _ in altered]) @ root, np.array([i for _, i in altered], np.int64)
    for _ in range(rounds):
        if not weight_pos.sum():
            break
        of_pos = weight_pos.sum() + weight_pos[origin].sum() / 6
        some = np.flatnonzero(weight_pos)
        w, bias = _svm([(phi[some], 1.0, weight_pos[some] / of_pos), (phi_altered, 1.0, weight_pos[origin] / 6 / of_pos), (phi, -1.0, 2 * neg / neg.sum())], 1e-5)
        margin = np.where(likely, phi @ w + bias, -np.inf)[flat]
        # witnesses: the word of each toxic sentence that the machine marks most, if it marks any
        best = np.maximum.reduceat(margin, begins)
        hit = (margin == np.repeat(best, size)) & (margin > 0)
        weight_pos = np.bincount(flat[hit], minlength=len(vocab)).astype(float)
    scorer = WordScorer(Model(marks.words, root @ w, bias, np.zeros(7)))
    margin = np.concatenate([np.empty(0), *(scorer.score(vocab[k : k + 8192]) for k in range(0, len(vocab), 8192))])
    feats = np.array([doc_features(margin[flat_all[cuts[k] : cuts[k + 1]]]) for k in range(len(toxic))])
    return Model(marks.words, root @ w, bias, _logistic(feats, y.astype(float)))


class WordScorer:
    def __init__(self, model: Model) -> None:
        self.model, self.marks = model, Landmarks(model.marks)
        self.table, self.weight = self.marks.folded(model.alpha)
        self.place: dict[str, int] = {}
        self.values = np.zeros(4096)

    def score(self, words: list[str]) -> np.ndarray:
        """Margins of words, the highest of its pieces for a long run."""
        cut, owner = list(words), np.arange(len(words))
        long = [i for i, w in enumerate(words) if len(w) > _LONGEST]
        if long:  # of the pieces of a long run the highest margin counts
            parts = [pieces(words[i]) for i in long]
            for i, p in zip(long, parts, strict=True):
                cut[i] = p[0]
            cut += [x for p in parts for x in p[1:]]
            owner = np.concatenate([owner, np.repeat(long, [len(p) - 1 for p in parts])])
        got = np.full(len(words), -np.inf)
        np.maximum.at(got, owner, (self.marks.shared(cut, self.table) ** 2) @ self.weight + self.model.bias)
        return got

    def _add(self, words: list[str]) -> None:
        got = np.concatenate([self.score(words[k : k + 8192]) for k in range(0, len(words), 8192)])
        used = len(self.place)
        if used + len(words) > len(self.values):
            self.values = np.append(self.values, np.zeros(max(len(words), len(self.values))))
        self.values[used : used + len(words)] = got
        self.place.update(zip(words, range(used, used + len(words)), strict=True))

    def margins(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.place)
        if new:
            if len(self.place) > _CACHE_WORDS:
                self.place.clear()
                new = set(words)
            self._add(list(new))
        return self.values[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [split_words(t or "") for t in texts]
        out = []
        for k in range(0, len(split), 256):
            part = split[k : k + 256]
            if len(self.place) > _CACHE_WORDS:
                self.place.clear()
            new = set().union(*part).difference(self.place)
            if new:
                self._add(list(new))
            for w in part:
                x = float(np.dot(doc_features(self.margins(w)), self.model.rule))
                out.append(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))))
        return out


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """A bounded number of labelled documents outside the held-out fold, by smallest id hash."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = sorted(got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [int(r.toxic) for r in rows]


def _scorer(key: str, model: Model) -> WordScorer:
    """One scorer for each process; found through the module, as a task's own globals are its own."""
    own_cache("toxicity", _MODELS.clear)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordScorer(model)
    return _MODELS[key]


def _scored(docs: DataFrame, labels: DataFrame, sample: int, columns: list[str]) -> DataFrame:
    """``row`` (a struct of the columns) and ``score``, in one pass without a shuffle."""
    model = fit(*training_sample(docs, labels, sample))
    release()
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    wrapped = docs.select(F.struct(*columns).alias("row"))
    at = columns.index("text")

    def rows(b: dict) -> dict:
        text = b["row"].field(at).to_pylist()
        score = [0.0] * len(text) if shared.value is None else _scorer(key, shared.value).scores(text)
        return {"row": b["row"] if keep else b["row"].field(0), "score": pa.array(score, pa.float64())}

    keep = len(columns) > 2
    kind = wrapped.schema["row"].dataType
    return map_arrow(wrapped, ["row"], StructType([StructField("row", kind if keep else kind[0].dataType), StructField("score", DoubleType())]), rows, ["row", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; rows keep no other column."""
    scored = _scored(docs, labels, sample, ["doc_id", "text"]).select(F.col("row").cast("long").alias("doc_id"), "score")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows whose text scores below one half, as they are, whatever their columns are named."""
    return _scored(docs, labels, sample, docs.columns).where("score < 0.5").select("row.*")
