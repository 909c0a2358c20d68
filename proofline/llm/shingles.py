"""Sets of hashed word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BLANK = {0x20, *range(0x09, 0x0E)}
_FOLD = bytes(0x20 if c in _BLANK else c + 32 if 65 <= c <= 90 else c for c in range(256))
_draw = np.random.default_rng(20_240_601)
_OF_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All sets in a row, each sorted, and their sizes.

    A-Z are lower-cased; words are runs of anything but space and the controls
    9 to 13. A text of fewer words than a shingle has is one shingle; a text
    without words, or null, has none. Hashes have 64 bits.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    full = np.flatnonzero(data != 32)
    sizes = np.zeros(len(raw), np.int64)
    if not len(full):
        return np.zeros(0, np.uint64), sizes
    first = np.flatnonzero(np.concatenate(([True], np.diff(full) > 1)))
    lengths = np.diff(np.concatenate((first, [len(full)])))
    place = np.arange(len(full)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    word = mix(np.add.reduceat(_OF_BYTE[data[full]] * powers[place], first) + lengths.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(ends, full[first], side="right")
    held = np.bincount(owner, minlength=len(raw))

    rolled = word[: max(0, len(word) - words + 1)].copy()
    for k in range(1, words):
        rolled = rolled * _BASE + word[k : len(word) - words + 1 + k]
    whole = owner[: len(rolled)] == owner[words - 1 :] if len(rolled) else np.zeros(0, bool)
    hashes, owners = [mix(rolled[whole])], [owner[: len(rolled)][whole]]
    starts = np.concatenate(([0], np.cumsum(held)[:-1]))
    short = np.flatnonzero((held > 0) & (held < words))
    if len(short):
        value = held[short].astype(np.uint64)
        for k in range(words - 1):
            has = held[short] > k
            at = np.minimum(starts[short] + k, len(word) - 1)
            value = np.where(has, value * _BASE + word[at], value)
        hashes.append(mix(value ^ np.uint64(0x5851F42D4C957F2D)))
        owners.append(short)
    value, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=len(raw))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
