"""Find which of many phrases occur in a text."""

from __future__ import annotations

import numpy as np

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


class PhraseFinder:
    """Substring hits of a list of phrases; an empty phrase is in every text."""

    # Below this number plain substring tests are faster.
    FEW = 64

    def __init__(self, phrases: list[str]):
        self.count = len(phrases)
        self.rows: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            self.rows.setdefault(phrase, []).append(i)
        self.always = self.rows.pop("", [])
        self.automaton = None
        if ahocorasick is not None and len(self.rows) > self.FEW:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.rows:
                self.automaton.add_word(phrase, phrase)
            self.automaton.make_automaton()

    def in_text(self, text: str) -> set[str]:
        if self.automaton is not None:
            return {phrase for _, phrase in self.automaton.iter(text)}
        return {phrase for phrase in self.rows if phrase in text}

    def hits(self, texts: list[str | None]) -> np.ndarray:
        """Matrix (phrases, texts) of 0 and 1."""
        found = np.zeros((self.count, len(texts)))
        found[self.always] = 1.0
        for column, text in enumerate(texts):
            if text is None:
                found[:, column] = 0.0
                continue
            for phrase in self.in_text(text):
                found[self.rows[phrase], column] = 1.0
        return found
