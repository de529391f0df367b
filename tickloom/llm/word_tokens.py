"""Token ids of whole texts, word by word, for tokenizers whose tokens never cross a blank.

A vocabulary that drops white space cuts a text at every blank before it merges anything, so the ids
of a text are those of its words one after the other. Words recur; each worker keeps the ids of those
it met and asks the tokenizer only for new ones, and merges a plain word without the steps around it. What is kept is emptied between
groups of texts once it holds ``REMEMBERED`` words, so memory follows that number and one group.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

REMEMBERED, LONG = 600_000, 48
#: Characters of texts handled together; a longer text is a group of its own.
GROUP = 1 << 20
_WORD = re.compile(r"[^ \t\n\r]+")
_LOADED: dict[str, WordTokens] = {}


def _words(text: str) -> list[str]:
    """Words between blanks. Four separators that Python counts as blanks are none to the vocabulary."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _WORD.findall(text)
    return text.split()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


_STOPS = ".,!?"
_LETTERS = dict(enumerate(byte_letters()))


def _plain(word: str) -> bool:
    """Latin letters only, that stay one letter each when composed and lower-cased: one piece to the vocabulary."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


class WordTokens:
    """Ids of texts as little-endian unsigned bytes, two or four an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call over all of them with a blank between."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids)), starts) * self.dtype.itemsize
        ids = self._ids(found.ids)
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _learn(self, words: set[str]) -> None:
        """A plain word, and the one stop behind it, merge apart; the rest is left to the whole tokenizer."""
        known, merge, rest = self.known, self.tokenizer.model.tokenize, []
        if "." not in known:
            known.update(zip(_STOPS, self._encoded(list(_STOPS))))
        for w in words:
            stop = w[-1] if w[-1] in _STOPS else ""
            own = w[:-1] if stop else w
            if not own or not _plain(own):
                rest.append(w)
                continue
            own = own.lower()
            if (ids := known.get(own)) is None:
                letters = own if own.isascii() else own.encode().decode("latin-1").translate(_LETTERS)
                ids = known[own] = self._ids([t.id for t in merge(letters)])
            known[w] = ids + known[stop] if stop else ids
        if rest:
            known.update(zip(rest, self._encoded(rest)))

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [_words(t) for t in texts]
        missing = set().union(*words) - self.known.keys()
        # Words too long to recur are not kept.
        once = {w: self._ids(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in missing if len(w) > LONG}
        self._learn(missing - once.keys() if once else missing)
        ids = (self.known | once if once else self.known).__getitem__
        return [b"".join(map(ids, ws)) for ws in words]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; null texts have none."""
        held, size = [], 0
        for t in texts:
            t = t or ""
            if held and size + len(t) > GROUP:
                yield from self._group(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield from self._group(held)


def loaded(path: str) -> WordTokens:
    """The tokenizer of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
