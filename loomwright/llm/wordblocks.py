"""Words, shingles and content-defined chunks of whole texts, hashed in NumPy blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
BLOCK = 1 << 20
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _random.integers(0, 2**64, size=(256, 256), dtype=np.uint64)
_ODD = _random.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: Sequence[str | None], letters: bytes = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, and offsets: text i has words offsets[i] to offsets[i + 1].

    A word is a longest stretch of `letters`. NULL and empty texts have none. Bytes are taken in blocks that end
    between words, so that a very long text needs no more memory at once than a short one, its bytes aside.
    """
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
    inside = np.zeros(256, dtype=bool)
    inside[list(letters)] = True
    hashes, places, at = [], [], 0
    while at < len(joined):
        end = min(at + BLOCK, len(joined))
        while end < len(joined) and inside[joined[end - 1]]:
            end += 1
        part = joined[at:end]
        wordly = inside[part]
        where = np.flatnonzero(wordly)
        if len(where):
            first = np.flatnonzero(np.diff(where, prepend=-2) != 1)
            within = np.arange(len(where)) - np.repeat(first, np.diff(first, append=len(where)))
            values = _BYTES[within & 255, part[where]]
            if within[-1] > 255 or within.max() > 255:
                values = values * (np.uint64(2) * (within >> 8).astype(np.uint64) + np.uint64(1))
            hashes.append(mix(np.add.reduceat(values, first)))
            places.append(where[first] + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(encoded) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def slices(texts: Sequence[str | None], most: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text is a range of its own."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of k consecutive words for each text, ascending, as values and offsets."""
    texts = len(offsets) - 1
    if len(hashes) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(texts + 1, dtype=np.int64)
    runs = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        runs = runs * _ODD[2] + hashes[j : len(hashes) - k + 1 + j]
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    inside = owner[: len(runs)] == owner[k - 1 :]
    runs, owner = mix(runs[inside]).view(np.int64), owner[: len(inside)][inside]
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    return runs, np.searchsorted(owner, np.arange(texts + 1))


def chunk_sets(hashes: np.ndarray, offsets: np.ndarray, window: int, divisor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of each text: distinct digests, their summed lengths in words, and offsets.

    A chunk ends behind a word if the rolling hash of the last `window` words is divisible by `divisor`, and at the
    text's end. So a chunk depends on words nearby alone, and an edit changes only the chunks it touches.
    """
    texts = len(offsets) - 1
    words = len(hashes)
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(texts + 1, dtype=np.int64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    rolling = np.zeros(words, dtype=np.uint64)
    for j in range(window):  # windows that begin before the text have a fixed value there
        back = np.zeros(words, dtype=np.uint64)
        back[j:] = np.where(owner[j:] == owner[: words - j], hashes[: words - j], np.uint64(0))
        rolling += back * _ODD[8 + j]
    ends = mix(rolling) % np.uint64(divisor) == 0
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    length = np.diff(first, append=words)
    within = (np.arange(words) - np.repeat(first, length)).astype(np.uint64)
    digest = mix(np.add.reduceat(mix(hashes + (within + np.uint64(1)) * _ODD[3]), first)).view(np.int64)
    whose = owner[first]
    order = np.lexsort((digest, whose))
    digest, whose, length = digest[order], whose[order], length[order]
    new = np.ones(len(digest), dtype=bool)
    new[1:] = (digest[1:] != digest[:-1]) | (whose[1:] != whose[:-1])
    total = np.add.reduceat(length, np.flatnonzero(new))
    return digest[new], total, np.searchsorted(whose[new], np.arange(texts + 1))


def sequence_digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each text's sequence of words; 0 for a text without words."""
    texts = len(offsets) - 1
    out = np.zeros(texts, dtype=np.uint64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        within = (np.arange(len(hashes)) - np.repeat(offsets[some], np.diff(offsets)[some])).astype(np.uint64)
        out[some] = mix(np.add.reduceat(mix(hashes + (within + np.uint64(1)) * _ODD[4]), offsets[some]))
    return out.view(np.int64)
