"""Bounded per-worker memo of what a word encodes to."""

from __future__ import annotations


class Memo(dict):
    """``memo[word]`` calls ``make(word)`` once; emptied by ``trim`` past ``most`` entries, so a worker's memory stays bounded."""

    def __init__(self, make, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
