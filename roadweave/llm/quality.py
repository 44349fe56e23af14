"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Votes are counted by pattern over
all documents (at most ``3 ** len(HEURISTICS)`` patterns, whatever the corpus), and expectation-
maximisation fits to these counts how often each heuristic votes each way on good and on bad
documents, and how common good ones are. Each pattern's posterior is then the soft label of its
documents, and a hashed linear scorer is trained on the posterior labels of a bounded sample, the
``sample`` documents with the smallest id hashes; it scores whole texts of all documents.

Features of the scorer: words, word shapes (case, letters, digits, kept punctuation) and shares of
character kinds, hashed to ``BITS`` bits, each block scaled by the text's length.

Cases: null and empty texts have no words, are scored as the posterior of their votes says and are
not kept; repeated rows are scored each; long texts cost in proportion; an empty table gives an
empty result; a corpus where the heuristics never differ scores by the prior; other columns are
ignored, and given quality labels are never read."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, own_cache, release

SAMPLE, BITS, ROUNDS = 4000, 15, 100
GOOD, BAD, NONE = 1, 0, 2
_CACHE_WORDS = 200_000
_SCORERS: dict[str, Scorer] = {}

_KIND = np.zeros(256, np.int64)  # 0: letters and bytes of other scripts
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "A" <= _c <= "Z" else 2 if _c in "0123456789" else 3 if _c in " \t\n\r\x0b\x0c" else 4 if _c in ".,;:'\"()?-" else 5 if _c == "|" else 6 if _b < 128 and not _c.isalpha() else 0


def measures(text: str | None) -> dict[str, float]:
    """What heuristics look at."""
    text = text or ""
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    n, letters = len(words), max(int(kinds[0] + kinds[1]), 1)
    size = max(len(text), 1)
    return {
        "words": n,
        "symbols": float(kinds[6]) / size,
        "bars": float(kinds[5]) / max(n, 1),
        "upper": float(kinds[1]) / letters,
        "repeats": sum(map(str.__eq__, words, words[1:])) / max(n - 1, 1),
        "distinct": len(set(words)) / max(n, 1) * max(n, 1) ** 0.25,
        "word_length": (size - float(kinds[3])) / max(n, 1),
        "stops": float(text.count(".") + text.count("?")) / max(n, 1),
    }


def _range(x: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    return BAD if x < bad_below or x > bad_above else GOOD if good_from <= x <= good_to else NONE


_INF = float("inf")
#: Each heuristic looks at one measure: bad outside the outer limits, good inside the inner ones.
#: Those that know one defect only have no inner range and never vote good.
HEURISTICS: tuple[tuple[str, float, float, float, float], ...] = (
    ("words", 8, 40, _INF, _INF),
    ("symbols", -1, 9, 9, 0.03),
    ("bars", -1, 9, 9, 0.1),
    ("upper", -1, 9, 9, 0.5),
    ("repeats", -1, 9, 9, 0.2),
    ("distinct", 0.6, 1.2, _INF, _INF),
    ("word_length", 2.5, 99, 99, 16),
    ("stops", 0.001, 0.02, 0.5, 0.9),
)
#: What heuristics are expected to do before any count is seen, (bad, good, nothing) on bad and on
#: good documents; how often those for one defect call bad and good documents bad; and how many
#: documents of each class that weighs as much as, whatever the corpus: the counts decide. Only the
#: false alarms of those for one defect (DEFECT[GOOD]) are set by hand: bad documents fail in one way
#: each, so no count of votes tells a defect from a habit of good documents.
EXPECTED, DEFECT, STRENGTH = ((0.25, 0.6, 0.15), (0.02, 0.75, 0.23)), (0.25, 0.0005), 5.0


def votes(text: str | None) -> int:
    """The pattern of all votes as one number in base three."""
    m, code = measures(text), 0
    for name, *limits in HEURISTICS:
        code = code * 3 + _range(m[name], *limits)
    return code


def unpack(code: int) -> list[int]:
    out = []
    for _ in HEURISTICS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def fit_labels(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for each pattern, and P(vote | class) for each heuristic."""
    codes = sorted(counts)
    v = np.array([unpack(c) for c in codes]).reshape(-1, len(HEURISTICS))
    n = np.array([counts[c] for c in codes], float)
    if not len(n):
        return {}, np.zeros((2, len(HEURISTICS), 3))
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    # any bad vote weighs more to begin with, as documents fail in one way and look good in others
    post = (1 + good) / (2 + good + 20 * bad)
    for _ in range(rounds):
        table = np.zeros((2, len(HEURISTICS), 3))
        for c, p in ((GOOD, post * n), (BAD, (1 - post) * n)):
            for h in range(len(HEURISTICS)):
                seen = [vote in v[:, h] for vote in (BAD, GOOD, NONE)]
                expected = np.where(seen, EXPECTED[c], 0)
                defect = HEURISTICS[h][2] > HEURISTICS[h][4]
                if defect:  # what is not bad is nothing
                    expected = np.where(seen, (DEFECT[c], 0, 1 - DEFECT[c]), 0)
                told = 0 if c == GOOD and defect else np.bincount(v[:, h], p, minlength=3)
                table[c, h] = told + STRENGTH * expected + 1e-6
        table /= table.sum(2, keepdims=True)
        prior = min(max((post * n).sum() / n.sum(), 1e-3), 1 - 1e-3)
        at = np.arange(len(HEURISTICS))
        logs = [np.log(x) + np.log(table[c, at, v]).sum(1) for c, x in ((GOOD, prior), (BAD, 1 - prior))]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - post).max() < 1e-10:
            break
        post = new
    return dict(zip(codes, post.tolist(), strict=True)), table


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Hasher:
    """Rows of two hashed features for each word: itself and its shape."""

    def __init__(self, bits: int = BITS) -> None:
        self.size, self.place = 1 << bits, {}
        self.rows: list[tuple[int, int]] = []

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(features, values); the features beyond the hashed ones are shares of characters."""
        words = (text or "").split()
        if len(self.place) > _CACHE_WORDS:
            self.place.clear()
        for w in set(words).difference(self.place):
            word = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % self.size
            self.place[w] = (word, zlib.crc32(b"\x00" + _shape(w).encode("utf-8", "surrogatepass")) % self.size)
        at = np.array(list(map(self.place.__getitem__, words)), np.int64).reshape(-1)
        m = measures(text)
        extra = np.array([min(m["symbols"] * 20, 2), min(m["bars"] * 5, 2), m["upper"], m["repeats"], min(m["distinct"] / 2, 2), min(np.log1p(m["words"]) / 5, 2), 1.0])
        return np.concatenate([at, self.size + np.arange(len(extra))]), np.concatenate([np.full(len(at), 1 / max(len(words), 1)), extra])


EXTRA = 7


def train_scorer(texts: list[str | None], soft: list[float], bits: int = BITS, rounds: int = 200) -> np.ndarray:
    """Logistic regression on soft labels by accelerated full-batch steps; deterministic."""
    hasher = Hasher(bits)
    got = [hasher(t) for t in texts]
    row = np.repeat(np.arange(len(got)), [len(f) for f, _ in got])
    col, val = np.concatenate([f for f, _ in got]), np.concatenate([x for _, x in got])
    y, size = np.array(soft), (1 << bits) + EXTRA
    w = z = np.zeros(size)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * z[col], minlength=len(y)), -30, 30)))
        new = z - 2.0 * (np.bincount(col, val * (p - y)[row], minlength=size) / len(y) + 1e-5 * z)
        z, w = new + t / (t + 3) * (new - w), new
    return w


class Scorer:
    def __init__(self, weights: np.ndarray, bits: int) -> None:
        self.weights, self.hasher = weights, Hasher(bits)

    def __call__(self, text: str | None) -> float:
        f, x = self.hasher(text)
        return float(1 / (1 + np.exp(-np.clip((self.weights[f] * x).sum(), -30, 30))))


def _scorer(key: str, weights: np.ndarray, bits: int) -> Scorer:
    """One scorer for each process; found through the module, as a task's own globals are its own."""
    own_cache("quality", _SCORERS.clear)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(weights, bits)
    return _SCORERS[key]


def classify(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score, kept."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = materialise(map_arrow(plain, ["doc_id", "text"], "doc_id long, votes int", lambda b: {"doc_id": b["doc_id"], "votes": pa.array([votes(t) for t in b["text"].to_pylist()], pa.int32())}, ["doc_id", "votes"]), "quality-votes")
    counts = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** heuristics
    post, _ = fit_labels(counts)
    chosen = voted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taken = plain.where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    texts = [r.text for r in sorted(taken, key=lambda r: r.doc_id)]
    weights = train_scorer(texts, [post.get(votes(t), 0.5) for t in texts], bits) if texts else np.zeros((1 << bits) + EXTRA)
    del texts, taken
    release()
    shared, key = docs.sparkSession.sparkContext.broadcast((weights, post)), uuid.uuid4().hex

    def rows(b: dict) -> dict:
        weights, post = shared.value
        scorer = _scorer(key, weights, bits)
        texts = b["text"].to_pylist()
        weak = [post.get(votes(t), 0.5) for t in texts]
        score = [scorer(t) if t and not t.isspace() else w for t, w in zip(texts, weak, strict=True)]
        kept = [s >= 0.5 and bool(t) and not t.isspace() for s, t in zip(score, texts, strict=True)]
        return {"doc_id": b["doc_id"], "weak_label": pa.array(weak, pa.float64()), "score": pa.array(score, pa.float64()), "kept": pa.array(kept, pa.bool_())}

    return map_arrow(plain, ["doc_id", "text"], "doc_id long, weak_label double, score double, kept boolean", rows, ["doc_id", "weak_label", "score", "kept"])
