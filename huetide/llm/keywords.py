"""A keyword automaton over UTF-8 bytes: the gate before regular expressions."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


class Keywords:
    """Finds all of a set of lower-case ASCII keywords in one pass over a text."""

    def __init__(self, words: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def hits(self, lowered: bytes) -> list[tuple[int, str]]:
        """First byte and keyword of each hit, in order of the last byte."""
        # latin-1 gives each byte one character, so positions stay byte positions
        return [(end + 1 - len(w), w) for end, w in self.automaton.iter(lowered.decode("latin-1"))]


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte position."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(raw[at:p].decode("utf-8", "replace"))
        out[p] = n
        at = p
    return out
