"""Sentences and code lines of whole texts and the words in them, found in NumPy blocks of code points."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

from loomwright.llm.wordblocks import mix

# Words that begin a line of code, signs that code has, signs that end a sentence or follow its end.
KEYWORDS = "return break continue pass import from else try yield raise".split()
CODE_SIGNS, ENDS, CLOSERS = "=[]{}();", ".!?", "\"')]"
PLANE = 1 << 16


@functools.lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Properties of code points, by rule; those beyond the first plane are looked up one by one, and have no case."""
    signs = [chr(c) for c in range(PLANE)]
    found = {
        "letter": [c.isalnum() and not c.isdecimal() for c in signs], "word": [c.isalnum() or c == "_" for c in signs], "space": [c.isspace() for c in signs],
        "small": ["a" <= c <= "z" or "ß" <= c <= "ÿ" for c in signs], "large": ["A" <= c <= "Z" for c in signs],
        "code": [c in CODE_SIGNS for c in signs], "end": [c in ENDS for c in signs], "closer": [c in CLOSERS for c in signs],
    }
    tables = {name: np.array([*values, name in ("letter", "word")]) for name, values in found.items()}
    lower = [c.lower() for c in signs]
    tables["lower"] = np.array([ord(b) if len(b) == 1 and ord(b) < PLANE else ord(a) for a, b in zip(signs, lower)], dtype=np.uint64)
    return tables


def term_hash(word: str) -> int:
    """The hash that unit_terms gives a lower-cased word."""
    return int(unit_terms([word])[0][0])


def unit_terms(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, places, offsets, units): the distinct words of each unit of each text, as 64-bit hashes.

    Text i has the entries offsets[i] to offsets[i + 1] of terms and places, by place; units[i] is how many units it has. A
    unit is a sentence or a line: it ends with a line, or behind a full stop, question or exclamation mark and a blank.
    Units without a letter don't count; those that neither end like a sentence nor look like code are headings, and count
    only if a text has nothing else. Words are stretches of letters, cut at humps (aB), and lower-cased.
    """
    t = _tables()
    joined = "\n".join((x or "").replace("\x00", " ") for x in texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(x or "") + 1 for x in texts])]).astype(np.int64)
    cp = np.minimum(raw, PLANE).astype(np.int64)
    nothing = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(len(texts), dtype=np.int64))
    seen = np.flatnonzero(~t["space"][cp])
    if not len(seen):
        return nothing
    signs = cp[seen]
    letter = t["letter"][cp]
    beyond = np.flatnonzero(raw >= PLANE)
    if len(beyond):
        kinds, which = np.unique(raw[beyond], return_inverse=True)
        letter[beyond] = np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in kinds.tolist()])[which]
    lines = np.cumsum((cp == 10) | (cp == 13))
    new = np.ones(len(seen), dtype=bool)
    apart = np.diff(seen) > 1
    new[1:] = apart & ((lines[seen[1:]] > lines[seen[:-1]]) | t["end"][signs[:-1]])
    first = np.flatnonzero(new)
    unit = np.cumsum(new) - 1
    lettered = np.add.reduceat(letter[seen].astype(np.int64), first) > 0
    last = np.maximum.reduceat(np.where(t["closer"][signs], -1, np.arange(len(seen))), first)
    proper = ((last >= 0) & t["end"][signs[np.maximum(last, 0)]]) | (np.add.reduceat(t["code"][signs].astype(np.int64), first) > 0)
    start = seen[first]
    for keyword in KEYWORDS:
        want = np.frombuffer(keyword.encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(start[:, None] + np.arange(len(want) + 1), len(cp) - 1)
        proper |= (cp[at[:, :-1]] == want).all(axis=1) & ~t["word"][cp[at[:, -1]]]
    proper &= lettered
    owner = np.searchsorted(begins, start, side="right") - 1
    has_proper = np.bincount(owner, proper, len(texts)) > 0
    kept = np.where(has_proper[owner], proper, lettered)
    units = np.bincount(owner, kept, len(texts)).astype(np.int64)
    number = np.cumsum(kept) - 1  # of a kept unit among all kept ones
    before = np.concatenate([[0], np.cumsum(units)])[:-1]

    letters = np.flatnonzero(letter)
    if not len(letters):
        return nothing
    fresh = np.ones(len(letters), dtype=bool)
    fresh[1:] = (np.diff(letters) > 1) | (t["small"][cp[letters[:-1]]] & t["large"][cp[letters[1:]]])
    at = np.flatnonzero(fresh)
    within = (np.arange(len(letters)) - np.repeat(at, np.diff(at, append=len(letters)))).astype(np.uint64)
    plain = np.where(cp[letters] < PLANE, t["lower"][np.minimum(cp[letters], PLANE - 1)], raw[letters].astype(np.uint64))
    hashes = mix(np.add.reduceat(mix((plain << np.uint64(32)) + within + np.uint64(1)), at)).view(np.int64)
    of_unit = unit[np.searchsorted(seen, letters[at])]
    inside = kept[of_unit]
    hashes, of_unit = hashes[inside], number[of_unit[inside]]
    order = np.lexsort((hashes, of_unit))
    hashes, of_unit = hashes[order], of_unit[order]
    once = np.ones(len(hashes), dtype=bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (of_unit[1:] != of_unit[:-1])
    hashes, of_unit = hashes[once], of_unit[once]
    text_of = np.repeat(np.arange(len(texts)), units)[of_unit]
    return hashes, of_unit - before[text_of], np.searchsorted(text_of, np.arange(len(texts) + 1)), units
