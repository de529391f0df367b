"""Words of whole texts as arrays of 64-bit hashes, for Arrow batches inside tasks.

A word's hash is a polynomial over its bytes, taken from one running sum, so no Python object is
made per word. Groups of texts of about ``GROUP`` bytes are handled together; a longer text is a
group of its own, cut at spaces while it is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GROUP = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Ladder:
    """Powers of an odd number and of its inverse modulo 2**64, kept and grown."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_IN_TEXT, _IN_WORDS = _Ladder(0x5851F42D4C957F2D | 1), _Ladder(0xD1342543DE82EF95)


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and where they start."""
    a = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    np.logical_not(_SPACE[a], out=word[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(word))
    starts, ends = edges[::2], edges[1::2]
    up, down = _IN_TEXT.upto(len(a))
    run = np.zeros(len(a) + 1, _U)
    np.cumsum(_BYTE[a] * up[:len(a)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts]), starts


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of a text above GROUP bytes; only words as long as GROUP are hashed by themselves."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > GROUP:
            cut = max(raw.rfind(bytes([c]), at, at + GROUP) for c in (32, 9, 10, 11, 12, 13))
            if cut < 0:
                nxt = [p for c in (32, 9, 10, 11, 12, 13) if (p := raw.find(bytes([c]), at + GROUP)) >= 0]
                end = min(nxt, default=len(raw))
                out.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end])], _U))
                at = end
                continue
            end = cut + 1
        out.append(_piece(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, _U)


def word_groups(texts: list[str | None], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) of consecutive rows; row ``first + i`` has the hashes ``bounds[i]:bounds[i + 1]``."""
    first, held, size = 0, [], 0

    def group(rows: list[bytes]):
        hashes, starts = _piece(b" ".join(rows))
        ends = np.cumsum([len(r) + 1 for r in rows])
        return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if lower else raw
        if held and size + len(raw) > GROUP:
            yield first, *group(held)
            first, held, size = i, [], 0
        if len(raw) > GROUP:
            hashes = _long(raw)
            yield i, hashes, np.array([0, len(hashes)])
            first = i + 1
        else:
            held.append(raw)
            size += len(raw)
    if held:
        yield first, *group(held)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes of one array; empty when there are fewer."""
    n = len(h)
    if n < k:
        return np.empty(0, _U)
    up, down = _IN_WORDS.upto(n)
    run = np.zeros(n + 1, _U)
    np.cumsum(h * up[:n], out=run[1:])
    return mix((run[k:] - run[:-k]) * down[:n - k + 1] + _U(k))


def winnowed(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every ``window`` consecutive ones, each once."""
    if len(g) < window:
        return np.empty(0, np.int64)
    places = np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + np.arange(len(g) - window + 1)
    return places[np.concatenate([[True], places[1:] != places[:-1]])]
