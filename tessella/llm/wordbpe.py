"""Token ids of a word-level BPE tokenizer, equal to the library's, at the cost of its distinct words.

The tokenizer drops white space before it merges anything and no merge, special string or
normalisation crosses ASCII white space, so the ids of a text are those of its words, end to end. In words of plain
characters it also splits before it merges, so their ids are those of their pieces.
Each Python worker keeps the ids of words and of pieces it has met in flat arrays, found by 64-bit hashes, within CACHE bytes
each; a full store starts anew, which only costs time.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hash_strings, hold, sums, words_of

#: Words of characters for which lower-casing, splitting and byte mapping are done here; one with any other goes through the whole library.
_PLAIN = "^[!-~À-ÖØ-öø-ÿŒœ]+$"
_PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9\x01]+)"
CACHE, BATCH = 48 << 20, 20_000


def _byte_chars() -> dict[int, str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Store:
    """Runs of ids by 64-bit keys, in flat arrays."""

    def __init__(self) -> None:
        self.key, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def nbytes(self) -> int:
        return 24 * len(self.key) + self.ids.nbytes

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys stand, or would stand; and which are missing."""
        order = np.argsort(key)  # sorted keys are found several times faster
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.key, key[order])
        known = np.append(self.key, np.uint64(0))[at] == key
        known[at == len(self.key)] = False
        return at, np.flatnonzero(~known)

    def add(self, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Add distinct keys that are missing, with their runs end to end."""
        end = np.cumsum(size) + self.used
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        order = np.argsort(key)
        to = np.searchsorted(self.key, key[order])
        self.key, self.start, self.size = (np.insert(x, to, y[order]) for x, y in ((self.key, key), (self.start, end - size), (self.size, size)))

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries at `at`, end to end, and the n + 1 offsets of the entries into them."""
        n = self.size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.start[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class WordBpe:
    """Encodes Arrow string arrays with a tokenizers file whose pre-tokenizer separates words at white space."""

    _open: dict[str, WordBpe] = {}

    @classmethod
    def at(cls, path: str) -> WordBpe:
        if path not in cls._open:
            cls._open[path] = cls(path)
        hold("tokens", cls._open.clear)
        return cls._open[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # for pieces that are already normalised and split
        self.chars = _byte_chars()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words, self.pieces = Store(), Store()

    def _encoded(self, library, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids end to end."""
        size, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(texts), BATCH):
            per = [e.ids for e in library.encode_batch_fast(texts[k : k + BATCH], add_special_tokens=False)]
            size.append(np.fromiter(map(len, per), np.int64, len(per)))
            ids.append(np.fromiter(chain.from_iterable(per), np.uint32, int(size[-1].sum())))
        return np.concatenate(size), np.concatenate(ids)

    def _of_pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids end to end, of words of plain characters."""
        parted = pc.replace_substring_regex(pc.utf8_lower(words), _PIECE, "\\1\x01")
        lists = pc.split_pattern(parted, "\x01")
        flat, at = lists.values, np.asarray(lists.offsets, np.int64)
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # an empty one stands at the end of each word
        at = np.concatenate([[0], np.cumsum(full)])[at]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        key = hash_strings(coded.dictionary)
        if self.pieces.nbytes() + 40 * len(key) > CACHE:
            self.pieces = Store()
        place, new = self.pieces.find(key)
        if len(new):
            shown = [x if x.isascii() else "".join(self.chars[b] for b in x.encode()) for x in coded.dictionary.take(pa.array(new)).to_pylist()]
            self.pieces.add(key[new], *self._encoded(self.bare, shown))
            place, _ = self.pieces.find(key)
        ids, ends = self.pieces.runs(place[coded.indices.to_numpy(zero_copy_only=False)])
        return np.diff(ends[at]), ids

    def _place(self, words: pa.Array) -> np.ndarray:
        """Where the (distinct) words stand among the known ones; missing ones are added."""
        key = hash_strings(words)
        if self.words.nbytes() + 40 * len(key) > CACHE:
            self.words = Store()
        at, new = self.words.find(key)
        if not len(new):
            return at
        fresh = words.take(pa.array(new))
        plain = pc.match_substring_regex(fresh, _PLAIN).to_numpy(zero_copy_only=False)
        for s in self.special:
            plain &= ~pc.match_substring(fresh, s).to_numpy(zero_copy_only=False)
        for mask, ids_of in ((plain, self._of_pieces), (~plain, lambda x: self._encoded(self.whole, x.to_pylist()))):
            own = np.flatnonzero(mask)
            if len(own):
                self.words.add(key[new[own]], *ids_of(fresh.take(pa.array(own))))
        return self.words.find(key)[0]

    def _known(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of the texts stand among the known ones, and the n + 1 offsets of the texts into them."""
        flat, at = words_of(texts)
        coded = flat.dictionary_encode()
        return self._place(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the n + 1 offsets of the texts into them."""
        own, at = self._known(texts)
        ids, ends = self.words.runs(own)
        return ids, ends[at]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        own, at = self._known(texts)
        return sums(self.words.size[own], at)
