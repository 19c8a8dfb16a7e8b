"""Vectorised hashing of words and runs of words in batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on together; a longer text is a chunk of its own.
CHUNK = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are what lies between blanks.
BLANK_SEPARATED = ~_SPACE
#: Words are runs of ASCII letters, digits and characters beyond ASCII.
ALPHANUMERIC = np.array([bytes([b]).isalnum() or b >= 0x80 for b in range(256)])

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunked(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of runs of texts with about ``most`` bytes."""
    run, first, size = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) > most:
            yield first, run
            run, first, size = [], i, 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def _scan(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and stop, the bounds of each text among them, prefix sums of hashed bytes, and what shifts a sum to its start."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = is_word[data]
    edges = np.flatnonzero(np.diff(flags))
    starts, stops = edges[::2], edges[1::2]
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return starts, stops, np.searchsorted(starts, begins), sums, down


def word_hashes(texts: list[bytes], is_word: np.ndarray = BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and the bounds of each text among them."""
    starts, stops, bounds, sums, down = _scan(texts, is_word)
    return mix((sums[stops] - sums[starts]) * down[starts]), bounds


def words_and_beginnings(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all alphanumeric words and of their first bytes where they are longer, and the index of each one's text."""
    starts, stops, bounds, sums, down = _scan(texts, ALPHANUMERIC)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    hashes, owners = [mix((sums[stops] - sums[starts]) * down[starts])], [of]
    for n in lengths:
        longer = stops - starts > n
        at = starts[longer]
        hashes.append(mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)))
        owners.append(of[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; of all its words if there are fewer."""
    factor = np.uint64(0xD6E8FEB86659FD93)
    for _, run in chunked(texts):
        words, bounds = word_hashes(run)
        rolled = words[: max(len(words) - width + 1, 0)].copy()
        for j in range(1, width):
            rolled = rolled * factor + words[j : len(words) - width + 1 + j]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        whole = whole * factor + w
                yield mix(np.array([whole], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
