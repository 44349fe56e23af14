"""Encoding texts with a public tokenizer file, one white-space word at a time.

The tokenizers used here join nothing over white space, so the ids of a text are the ids of its
words in order. Words repeat far more than texts do, so Arrow cuts a batch into words, numbers the
distinct ones, cuts those into pieces as the tokenizer's own splitting rule does, and numbers the
distinct pieces; only pieces are encoded, and the texts' ids are gathered by number. Pieces are
looked up in a cache of two generations, which forgets those not met for longest and never those in
constant use, so its size is bounded while the frequent ones stay. Unknown pieces are handed to the
library end to end and told apart by the word-end mark that closes every piece's last token.

This is for texts of Latin letters, digits and printable signs, for which lower-casing, composition
and white space are the same to Arrow and to the library. Other texts go to the library whole, as do
texts that may spell a special token."""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import own_cache

#: Printable ASCII, tab and line ends, Latin-1 letters.
_PLAIN = r"^[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*$"
#: The splitting rule of the word tokenizer (fixed value), for those characters in lower case.
_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+)"
#: Pieces and ids in one generation of the cache; longer pieces are not kept. Pieces encoded at once.
_CACHE_PIECES, _CACHE_IDS, _LONGEST, _JOINED = 300_000, 4_000_000, 64, 512
_ENCODERS: dict[tuple, Encoder] = {}


class Generation:
    """Pieces by place, and where the ids of each place lie in a pool. The empty piece has none."""

    def __init__(self, dtype: str) -> None:
        self.place: dict[str, int] = {"": 0}
        self.pool, self.begin, self.size = np.empty(0, dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, pieces: list[str]) -> np.ndarray:
        """Their places, -1 where unknown."""
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places end to end, and how many each has."""
        return gathered(self.pool, self.begin[at], self.size[at]), self.size[at]

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Appends pieces and returns their places; those too long to keep get one, but no name."""
        at = np.arange(len(self.size), len(self.size) + len(pieces))
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(size) - size)
        self.size, self.pool = np.append(self.size, size), np.append(self.pool, ids)
        self.place.update((p, k) for p, k in zip(pieces, at.tolist(), strict=True) if len(p) <= _LONGEST)
        return at


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a pool end to end."""
    upto = np.cumsum(size)
    return pool[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - upto + size, size)]


class Encoder:
    """Ids as little-endian integers of ``width`` bytes each."""

    def __init__(self, path: str, width: int, special_as_text: bool) -> None:
        # one task, one core: the library's own threads would wait for each other in every worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = {2: "<u2", 4: "<u4"}[width]
        if self.tokenizer.get_vocab_size() > 1 << (8 * width):
            raise ValueError(f"ids of this tokenizer do not fit into {width} bytes")
        self.recent, self.older = Generation(self.dtype), Generation(self.dtype)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[ends] = True
        self.joins = bool(ends) and self._closed("a b'c 1.,_ x")

    def _closed(self, text: str) -> bool:
        """Whether the pieces of a text are those of the rule, each closed by its last token."""
        cut = [p for w in text.split() for p in re.findall(_PIECES, w)]
        each = [self._ids(p) for p in cut]
        ids, size = self._fresh(cut) if all(self.closes[x[-1]] and not self.closes[x[:-1]].any() for x in each) else ((), ())
        return list(ids) == self._ids(text) == [i for x in each for i in x] and list(size) == list(map(len, each))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has."""
        joined = [" ".join(pieces[k : k + _JOINED]) for k in range(0, len(pieces), _JOINED)]
        ids = np.concatenate([np.empty(0, self.dtype), *(np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False))])
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], self.dtype), np.array([len(x) for x in got], np.int64)

    def _known(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and how many each has."""
        now = self.recent
        if len(now.place) + len(pieces) > _CACHE_PIECES or len(now.pool) > _CACHE_IDS:
            self.recent, self.older = Generation(self.dtype), now
            now = self.recent
        at = now.find(pieces)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            names = [pieces[k] for k in missing.tolist()]
            old = self.older.find(names)
            for chosen, ids_of in ((np.flatnonzero(old >= 0), lambda k, _: self.older.ids(old[k])), (np.flatnonzero(old < 0), lambda _, x: (self._fresh if self.joins else self._each)(x))):
                if len(chosen):
                    these = [names[k] for k in chosen.tolist()]
                    at[missing[chosen]] = now.add(these, *ids_of(chosen, these))
        return now.ids(at)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary
        if self.joins:
            cut = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(pc.replace_substring_regex(words, _PIECES, r"\1 ")))
            pieces = cut.flatten().dictionary_encode()
            ids, size = self._known(pieces.dictionary.to_pylist())
            piece = pieces.indices.to_numpy(zero_copy_only=False)
            n, count = size[piece], pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
            pool = gathered(ids, (np.cumsum(size) - size)[piece], n)
            size = np.diff(np.concatenate(([0], np.cumsum(n)))[np.cumsum(count)], prepend=0)
        else:
            pool, size = self._known(words.to_pylist())
        # leading or trailing white space leaves an empty word, which has no ids
        word = numbered.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        return gathered(pool, (np.cumsum(size) - size)[word], n), np.concatenate(([0], np.cumsum(n)))[np.cumsum(each)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's end. A null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.or_(pc.invert(pc.match_substring_regex(texts, _PLAIN)), pc.match_substring(texts, "<|"))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._plain(texts)
        # the plain ones as one batch, the others one by one, put back in order
        flat, ends = self._plain(texts.filter(pc.invert(whole)))
        parts = np.split(flat, ends[:-1]) if len(ends) else []
        for k, t in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist(), strict=True):
            parts.insert(k, np.array(self._ids(t), self.dtype))
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with the end id after each text."""
        flat, ends = self.encode(texts)
        out, upto = np.empty(len(flat) + len(ends), self.dtype), ends + np.arange(1, len(ends) + 1)
        here = np.ones(len(out), bool)
        here[upto - 1] = False
        out[here], out[~here] = flat, end_id
        return out, upto


def encoder(path: str, width: int = 4, special_as_text: bool = False) -> Encoder:
    """One encoder, and so one cache, for each process."""
    own_cache("encoding", _ENCODERS.clear)
    key = (path, width, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, width, special_as_text)
    return _ENCODERS[key]
