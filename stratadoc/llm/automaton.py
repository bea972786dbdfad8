"""Generalised suffix automaton over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """Accepts every run of words of the sequences that were added."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: Sequence) -> list[int]:
        """Adds a sequence; the state of each of its prefixes."""
        states, at = [], 0
        for word in words:
            at = self._extend(at, word)
            states.append(at)
        return states

    def _new(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, above: int, word, to: int) -> int:
        """The state of above's longest run and word, when to also stands for longer runs."""
        if self.length[to] == self.length[above] + 1:
            return to
        part = self._new(self.length[above] + 1)
        self.step[part] = dict(self.step[to])
        self.link[part], self.link[to] = self.link[to], part
        while above >= 0 and self.step[above].get(word) == to:
            self.step[above][word] = part
            above = self.link[above]
        return part

    def _extend(self, last: int, word) -> int:
        to = self.step[last].get(word)
        if to is not None:
            return self._split(last, word, to)
        new, above = self._new(self.length[last] + 1), last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, word, self.step[above][word])
        return new

    def stream(self, words: Sequence) -> Iterator[tuple[int, int, int]]:
        """Matching statistics: (n, state, length) where the longest suffix of the first n words that occurs isn't empty."""
        step, link, length = self.step, self.link, self.length
        root = step[0]
        state = matched = 0
        for n, word in enumerate(words, 1):
            if state:
                to = step[state].get(word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step[state].get(word)
            else:
                to = root.get(word)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
                yield n, state, matched
