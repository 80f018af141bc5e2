"""Word and shingle hashes of whole batches of texts, without a loop over words."""

from __future__ import annotations

import functools
import hashlib
import secrets

import numpy as np

WORDS = 5
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Longer words are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POSITION = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(WORDS)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def secret_key() -> int:
    """A key that nobody can make colliding words for beforehand; one for all tasks of a run."""
    return secrets.randbits(63)


@functools.lru_cache(maxsize=8)
def _secrets(key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each eight bytes of a word a mask and an odd factor, and a mask for each length."""
    rng = np.random.default_rng(key)
    draw = lambda n: rng.integers(1 << 64, size=n, dtype=np.uint64)
    return draw(LONG // 8), draw(LONG // 8) | np.uint64(1), draw(LONG + 1)


def words_of(texts: list[str], key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z in lower case, where each text's words begin (one
    entry more than there are texts), the bytes, and where words start and end there.

    Every eight bytes of a word are masked, multiplied and mixed by numbers that ``key``
    gives, and added up; the length masks the first. Of words over ``LONG`` bytes the hash is a
    part of their BLAKE2 digest under the key. Two words have one hash with a chance of
    about 2^-64 over keys; so where equality decides a result, the key is a ``secret_key``.
    """
    masks, factors, of_length = _secrets(key)
    coded = [t.encode() for t in texts]
    raw = b"\n".join([*coded, b""]).translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[data].view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    wide = np.ndarray(len(data), "<u8", raw + bytes(8), strides=(1,))
    left = ends - starts
    hashes = mix(((wide[starts] & _MASK[np.minimum(left, 8)]) ^ of_length[np.minimum(left, LONG)]) * factors[0])
    rest = np.flatnonzero((left > 8) & (left <= LONG))
    for k in range(8, LONG, 8):
        rest = rest[left[rest] > k]
        hashes[rest] += mix(((wide[starts[rest] + k] & _MASK[np.minimum(left[rest] - k, 8)]) ^ masks[k // 8]) * factors[k // 8])
    for k in np.flatnonzero(left > LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    texts_at = np.cumsum([0, *(len(c) + 1 for c in coded)])
    return hashes, np.searchsorted(starts, texts_at), data, starts, ends


def edges_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First and last eight bytes and the length of each word of ``words_of``."""
    wide = np.ndarray(len(data), "<u8", data.tobytes() + bytes(8), strides=(1,))
    size = ends - starts
    mask = _MASK[np.minimum(size, 8)]
    return np.stack([wide[starts] & mask, wide[np.maximum(ends - 8, starts)] & mask, size.astype(np.uint64)], 1)


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, by one sort."""
    x = np.sort(x)
    return x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] if len(x) else x


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each stands, and each item's number among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(x) else np.zeros(0, bool)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ranked[at], order[at], which


def word_hashes(texts: list[str], key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first two of ``words_of``."""
    return words_of(texts, key)[:2]


def shingle_sets(texts: list[str], key: int = 0) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer than ``WORDS`` words the whole
    sequence as one, without words none."""
    words, at = word_hashes(texts, key)
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += mix(words[k : k + len(runs)] + _POSITION[k])
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(distinct(runs[a : b - WORDS + 1]))
        elif n:
            out.append(mix(np.array([np.sum(mix(words[a:b] + _POSITION[:n]), dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(words[:0])
    return out
