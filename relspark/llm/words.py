"""Words of many texts at once, as arrays of hashes: no object is made for a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256)
#: ASCII white space by byte, bytes with A-Z in lower case, and a number for each byte in lower case.
SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64)
VALUE = mix(LOWER + GOLD)
POWERS = np.cumprod(np.full(1 << 16, M1, np.uint64), dtype=np.uint64)
#: Bytes of text that are worked on at once, where a word ends, and bytes of texts in a group.
PART, GROUP = 1 << 20, 4 << 20


def spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words of bytes, and the places of all bytes that are in one."""
    on = ~SPACE[text]
    edges = np.flatnonzero(np.diff(on, prepend=False, append=False))
    return edges[::2], edges[1::2], np.flatnonzero(on)


def summed(value: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per word, the sum of its values times the powers of their places in it."""
    place = np.arange(len(value)) - np.repeat(first, size)
    value = value * POWERS[place & 0xFFFF]
    far = np.flatnonzero(place >> 16)
    value[far] *= POWERS[place[far] >> 16]
    return np.add.reduceat(value, first)


def plain(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of bytes, A-Z in lower case."""
    start, end, at = spans(text)
    if not len(start):
        return start, np.empty(0, np.uint64)
    size = end - start
    return start, mix(summed(VALUE[text[at]], np.cumsum(size) - size, size) + size.astype(np.uint64) * GOLD)


def scanned(texts: list[bytes], of: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words in each text, what `of` finds beside their starts), a part at a time, so memory doesn't grow with a text's bytes."""
    text, found, at = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), [], 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not len(gap := np.flatnonzero(SPACE[text[end : end + 4096]])):
            end += 4096
        end = end + int(gap[0]) if at + PART < len(text) and end < len(text) else len(text)
        start, *more = of(text[at:end])
        found.append((start + at, *more))
        at = end
    start, *more = (np.concatenate(x) for x in zip(*found, strict=True))
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.diff(np.searchsorted(start, bounds), prepend=0), more


def places(n: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each of consecutive texts of n words."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def grouped(texts: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of at most GROUP bytes together; a longer one is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
