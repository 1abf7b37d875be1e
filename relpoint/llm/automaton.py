"""Generalised suffix automaton over the words of a bounded set of items."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Smallest automaton of all runs of consecutive words of the items.

    ``next``, ``link`` and ``length`` by state; state 0 is the empty run. ``whole[s]`` lists (words, item
    number) of the items that are, as a whole, the longest run of state s.
    """

    def __init__(self, items: Sequence[Sequence[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, list[int]] = {}
        self.ends: dict[int, set[int]] = {}
        for number, words in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.ends.setdefault(last, set()).add(number)
            if words:
                self.whole.setdefault(last, []).append(number)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, state: int, source: int, word: int) -> int:
        """Split off the runs of ``source`` that end behind ``state``, and lead the way to them."""
        copy = self._state(self.length[state] + 1, self.link[source], dict(self.next[source]))
        self.link[source] = copy
        while state >= 0 and self.next[state].get(word) == source:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            exact = self.length[there] == self.length[state] + 1
            self.link[new] = there if exact else self._clone(state, there, word)
        return new

    def at_length(self, words: int) -> list[int]:
        """For each state, the one that holds its suffix of so many words; -1 if it is shorter."""
        found = [-1] * len(self.length)
        for s in sorted(range(len(found)), key=self.length.__getitem__):
            if self.length[s] >= words:
                up = self.link[s]
                found[s] = found[up] if self.length[up] >= words else s
        return found

    def items_at(self, words: int) -> dict[int, set[int]]:
        """Items that contain the run of so many words, for each state that holds one."""
        anchor, found = self.at_length(words), {}
        for s, numbers in self.ends.items():
            if anchor[s] >= 0:
                found.setdefault(anchor[s], set()).update(numbers)
        return found

    def whole_suffixes(self) -> list[tuple[tuple[int, int], ...]]:
        """For each state (words, item) of the items that are suffixes of its longest run, shortest first."""
        found: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for s in sorted(range(len(found)), key=self.length.__getitem__):
            if s:
                found[s] = found[self.link[s]] + tuple((self.length[s], n) for n in self.whole.get(s, ()))
        return found

    def statistics(self, words: Sequence[bytes], least: int) -> list[tuple[int, int, int]]:
        """(place, state, length) wherever the longest run that ends at a word has ``least`` words or more.

        Places are those of the last word. The length may be less than that of the state's longest run.
        """
        ids, following, link, longest = self.ids, self.next, self.link, self.length
        found, state, length = [], 0, 0
        for place, word in enumerate(map(ids.get, words)):
            if word is None:
                state = length = 0
                continue
            there = following[state].get(word)
            while there is None and state:
                state = link[state]
                length = longest[state]
                there = following[state].get(word)
            if there is None:
                length = 0
                continue
            state = there
            length += 1
            if length >= least:
                found.append((place, state, length))
        return found
