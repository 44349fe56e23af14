"""Language identification by unigram pieces with all segmentations summed.

Pieces come from a fixed public SentencePiece vocabulary. Each language has a probability for every
piece; the likelihood of a word is the sum, over all ways to cut it into pieces, of the product of
their probabilities, computed by the forward algorithm. No piece crosses a word boundary, so a
text's log-likelihood is the sum over its words, which are scored once for each process and cached.
Probabilities are fitted by expectation-maximisation: the forward-backward counts of pieces over the
training words of a language become its next probabilities.

Training takes a bounded sample: of the ``langs`` values of lang that most documents outside the
held-out fold have (ties by name), the ``docs_per_lang`` documents with the smallest id hashes, whole.
Languages train side by side, one task each. Everything in a text is scored.

Cases: a null text, or one without letters, is ``und`` with score 0; letters outside the vocabulary
cost a fixed small probability in every language; ties go to the first language in order of name;
repeated rows are scored each; with no training documents every text is ``und``; other columns are
ignored, lang and source of a document never enter its score."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, map_arrow, own_cache

DOCS_PER_LANG, LANGS, ROUNDS, HELD_OUT_FOLD, FOLDS = 300, 256, 3, 1, 3
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
_UNKNOWN = 1e-9
#: Runs of letters this long are taken one at a time with rescaled sums, as products of so many
#: factors vanish.
_LONGEST = 32
_CACHE_WORDS = 200_000
_TRIES: dict[str, Trie] = {}
_SCORERS: dict[str, Scorer] = {}


class Trie:
    """The pieces as a trie in sorted arrays: ``keys`` holds state * 2**21 + character, the state
    after it is its place plus one; ``piece`` has the piece that ends in a state, or -1."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.size, self.ids = sp.get_piece_size(), np.array(sorted(known.values()))
        # states level by level: keys of deeper levels have larger states, so they come sorted
        state, keys = {"": 0}, []
        level = sorted({p[:1] for p in known})
        while level:
            level.sort(key=lambda x: (state[x[:-1]], x[-1]))
            for x in level:
                keys.append((state[x[:-1]] << 21) + ord(x[-1]))
                state[x] = len(keys)
            deeper = len(level[0]) + 1
            level = list({p[:deeper] for p in known if len(p) >= deeper})
        self.keys = np.array(keys, np.int64)
        self.piece = np.full(len(keys) + 1, -1, np.int64)
        for p, i in known.items():
            self.piece[state[p]] = i

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Lengths of the words, and (word, start, end, piece) of every piece in them; -1 is a
        letter that is no piece."""
        n = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        offset = np.repeat(np.cumsum(n) - n, n)
        at = np.arange(len(text))
        end_of_word = offset + n[word] if len(words) else at
        start, state, length = at, np.zeros(len(text), np.int64), 0
        got, single = [], np.ones(len(text), bool)
        while len(start):
            q = (state << 21) + text[start + length]
            place = np.searchsorted(self.keys, q)
            ok = self.keys[np.minimum(place, len(self.keys) - 1)] == q
            start, state, length = start[ok], place[ok] + 1, length + 1
            piece = self.piece[state]
            ends = piece >= 0
            got.append((start[ends], np.full(int(ends.sum()), length), piece[ends]))
            if length == 1:
                single[start[ends]] = False
            more = start + length < end_of_word[start]
            start, state = start[more], state[more]
        lone = np.flatnonzero(single)
        got.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        s, ln, p = (np.concatenate(x) for x in zip(*got, strict=True))
        first = s - offset[s]
        return n, word[s], first, first + ln, p


def trie(model_file: str) -> Trie:
    if model_file not in _TRIES:
        _TRIES[model_file] = Trie(model_file)
    return _TRIES[model_file]


def train_pieces(counts: dict[str, int], model_file: str, rounds: int = ROUNDS, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities that fit the words of one language, by forward-backward counts."""
    ids = trie(model_file).ids
    prob = np.zeros(trie(model_file).size)
    prob[ids] = 1.0 / len(ids)
    words = [w for w in counts if len(w) < _LONGEST]
    lattice = Lattice([_START + w for w in words], model_file)
    c = np.array([counts[w] for w in words], float)
    long = [(counts[w], trie(model_file).edges([_START + w])) for w in counts if len(w) >= _LONGEST]
    for _ in range(rounds):
        got = lattice.expected(prob, c)
        for n, edges in long:
            long_expected(edges, prob, n, got)
        got[ids] += smooth
        prob = got / got.sum()
    return prob


def long_expected(edges: tuple[np.ndarray, ...], prob: np.ndarray, count: float, out: np.ndarray) -> None:
    """Adds the expected counts of the pieces in one long run that occurs so often. The sums up to a
    place and from it on are scaled place by place; pieces reach a few places back, so the scales
    between a piece's ends are multiplied out."""
    n, (_, _, start, end, piece) = int(edges[0][0]), edges
    order = np.argsort(end, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    p = np.where(piece >= 0, prob[piece], _UNKNOWN)
    cuts = np.searchsorted(end, np.arange(n + 2))
    f, log = np.zeros(n + 1), np.zeros(n + 1)
    f[0] = 1.0
    for j in range(1, n + 1):
        a, b = cuts[j], cuts[j + 1]
        i = start[a:b]
        total = (f[i] * p[a:b] * np.exp(log[i] - log[j - 1])).sum()
        f[j], log[j] = 1.0, log[j - 1] + np.log(max(total, 1e-300))
    back = np.zeros(n + 1)  # chance that a cut is at a place, given the run
    back[n] = count
    for j in range(n, 0, -1):
        a, b = cuts[j], cuts[j + 1]
        share = back[j] * f[start[a:b]] * p[a:b] * np.exp(log[start[a:b]] - log[j])
        np.add.at(back, start[a:b], share)
        known = piece[a:b] >= 0
        np.add.at(out, piece[a:b][known], share[known])


class Lattice:
    """All segmentations of many short words, laid out for array operations: edges by end."""

    def __init__(self, words: list[str], model_file: str) -> None:
        self.n, word, start, end, piece = trie(model_file).edges(words)
        # edges ordered by end, within it by word
        order = np.lexsort((word, end))
        self.word, self.end, self.start, self.piece = word[order], end[order], start[order], piece[order]
        self.width = int(self.n.max(initial=0)) + 1
        self.cuts = np.searchsorted(self.end, np.arange(self.width + 1))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Likelihoods (word, end, language) of what comes before each end; probs (piece, language)."""
        f = np.zeros((len(self.n), self.width, probs.shape[1]))
        f[:, 0] = 1.0
        p = np.where((self.piece >= 0)[:, None], probs[self.piece], _UNKNOWN)
        for j in range(1, self.width):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                w = self.word[a:b]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                f[w[first], j] = np.add.reduceat(f[w, self.start[a:b]] * p[a:b], first, axis=0)
        return f

    def expected(self, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words that occur so often."""
        f = self.forward(prob[:, None])[:, :, 0]
        p = np.where(self.piece >= 0, prob[self.piece], _UNKNOWN)
        rows = np.arange(len(self.n))
        back = np.zeros_like(f)
        whole = f[rows, self.n]
        back[rows, self.n] = np.where(whole > 0, count / np.maximum(whole, 1e-300), 0.0)
        out = np.zeros(len(prob))
        for j in range(self.width - 1, 0, -1):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                w, i, k = self.word[a:b], self.start[a:b], self.piece[a:b]
                q = back[w, j] * p[a:b]
                np.add.at(back, (w, i), q)
                known = k >= 0
                np.add.at(out, k[known], (f[w, i] * q)[known])
        return out


class Scorer:
    """Log-likelihoods of words under each language, cached."""

    def __init__(self, langs: list[str], probs: np.ndarray, model_file: str) -> None:
        self.langs, self.model_file, self.probs = langs, model_file, np.ascontiguousarray(probs.T) if len(langs) else np.zeros((0, 0))
        self._clear()

    def _clear(self) -> None:
        # row 0 is that of words without letters
        self.place: dict[str, int] = {}
        self.table, self.used = np.zeros((4096, len(self.langs))), 1

    def _long(self, word: str) -> np.ndarray:
        """A long run of letters: the same sums, rescaled as they go."""
        edges: dict[int, list[tuple[int, int]]] = {}
        _, _, starts, ends, ps = trie(self.model_file).edges([_START + word])
        for j, i, k in zip(ends.tolist(), starts.tolist(), ps.tolist(), strict=True):
            edges.setdefault(j, []).append((i, k))
        unknown = np.full(len(self.langs), _UNKNOWN)
        logs = [np.zeros(len(self.langs))]
        for j in range(1, len(word) + 2):
            parts = np.array([logs[i] + np.log(self.probs[k] if k >= 0 else unknown) for i, k in edges[j]])
            top = parts.max(0)
            logs.append(top + np.log(np.exp(parts - top).sum(0)))
        return logs[-1]

    def add(self, words: list[str]) -> None:
        """Scores new words: all short runs of letters of them at once."""
        found = [[w] if w.isalpha() else _LETTERS.findall(w) for w in words]
        runs = list({r for f in found for r in f if len(r) < _LONGEST})
        logs = np.zeros((len(runs), len(self.langs)))
        for k in range(0, len(runs), 20000):
            part = runs[k : k + 20000]
            lattice = Lattice([_START + r for r in part], self.model_file)
            logs[k : k + len(part)] = np.log(np.maximum(lattice.forward(self.probs)[np.arange(len(part)), lattice.n], 1e-300))
        place = dict(zip(runs, range(len(runs)), strict=True))
        need = self.used + len(words)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((max(need, len(self.table)), len(self.langs)))])
        one = [(w, place[f[0]]) for w, f in zip(words, found, strict=True) if len(f) == 1 and f[0] in place]
        self.table[self.used : self.used + len(one)] = logs[[k for _, k in one]] if one else 0
        self.place.update(zip([w for w, _ in one], range(self.used, self.used + len(one)), strict=True))
        self.used += len(one)
        for w, f in zip(words, found, strict=True):
            if not f:
                self.place[w] = 0
            elif w not in self.place:
                self.table[self.used] = sum(logs[place[r]] if r in place else self._long(r) for r in f)
                self.place[w] = self.used
                self.used += 1

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out = []
        for k in range(0, len(texts), 256):
            split = [(t or "").lower().split() for t in texts[k : k + 256]]
            if self.used > _CACHE_WORDS:
                self._clear()
            self.add(list(set().union(*split).difference(self.place)))
            out += [self._best(w) for w in split]
        return out

    def _best(self, words: list[str]) -> tuple[str, float]:
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if not at.any():
            return "und", 0.0
        scores = self.table[at].sum(0)
        scores -= scores.max()
        best = int(scores.argmax())
        return self.langs[best], float(1 / np.exp(scores).sum())


def train(docs: DataFrame, model_file: str, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS, langs: int = LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from documents outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT_FOLD)).select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most `langs` rows
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    # the smallest hashes lie below a limit that leaves about twice as many as asked, so only those
    # are ranked, however many documents a language has
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)
    near = usable.select("lang", "doc_id", u.alias("u")).join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("n") <= 2 * docs_per_lang + 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    chosen = near.withColumn("r", rank).where(F.col("r") <= docs_per_lang).select("lang", "doc_id").distinct()
    # at most docs_per_lang rows for each of at most `langs` languages
    sample = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for t in pdf.sort_values("doc_id", na_position="first")["text"]:
            counts.update(_LETTERS.findall(t.lower()))
        prob = train_pieces(counts, model_file, rounds)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "prob": [prob.astype("<f8").tobytes()]})

    got = sorted((r.lang, np.frombuffer(bytes(r.prob), "<f8")) for r in sample.groupBy("lang").applyInPandas(fit, "lang string, prob binary").collect())
    return [g[0] for g in got], np.array([g[1] for g in got])


def _scorer(key: str, model: tuple, model_file: str) -> Scorer:
    """One scorer for each process; found through the module, as a task's own globals are its own."""
    own_cache("langid", _SCORERS.clear)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(*model, model_file)
    return _SCORERS[key]


def identify(docs: DataFrame, model_file: str, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS, langs: int = LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (probability of the language, all equally likely before)."""
    model = train(docs, model_file, docs_per_lang, rounds, langs)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def rows(b: dict) -> dict:
        got = _scorer(key, shared.value, model_file).texts(b["text"].to_pylist())
        return {"doc_id": b["doc_id"], "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "doc_id long, lang_pred string, score double", rows, ["doc_id", "lang_pred", "score"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score")
