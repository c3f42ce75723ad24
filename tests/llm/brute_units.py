"""Sentences, code lines and words by regular expressions: what loomwright.llm.units finds in blocks."""

import re
WORD = re.compile(r"[^\W\d_]+")
HUMP = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")
BREAK = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
SENTENCE = re.compile(r"[.!?][\"')\]]*$")
CODE = re.compile(r"[=\[\]{}();]|^(?:return|break|continue|pass|import|from|else|try|yield|raise)\b")


def words_of(unit: str) -> list[str]:
    """Lower-cased words; names in code are cut at underscores, digits and humps."""
    found = []
    for word in WORD.findall(unit):
        if word[1:].islower() or len(word) == 1:
            found.append(word.lower())
        else:
            found.extend(part.lower() for part in HUMP.split(word))
    return found


def units_of(text: str) -> list[list[str]]:
    """The sentences and code lines of a text as lists of words. Headings count only if there is nothing else."""
    units = [u for u in (u.strip() for u in BREAK.split(text)) if WORD.search(u)]
    proper = [u for u in units if SENTENCE.search(u) or CODE.search(u)]
    return [words_of(u) for u in proper or units]


