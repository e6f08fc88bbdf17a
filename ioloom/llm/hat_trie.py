"""HAT-trie counts of short word sequences: hash containers under a shallow trie of word ids.

A sequence of up to three word ids is one number, the first id in its highest bits, so a subtree of the trie is a range of
numbers. A container is a hash table for one range. It bursts in two when it has too many entries, between two first
words, or, if all its entries share that, between two second words: frequent words get containers of their own. Words'
own counts are an array beside the trie.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Bits of an id; three ids fit a signed number.
ID_BITS = 21
BURST = 1 << 16


class HatTrie:
    def __init__(self, burst: int = BURST):
        self.burst, self.edges, self.containers = burst, np.zeros(1, np.int64), [Counter()]

    def __len__(self) -> int:
        return sum(map(len, self.containers))

    def add(self, codes: np.ndarray) -> None:
        """Counts each of codes once."""
        if len(self.containers) == 1:
            self.containers[0].update(codes.tolist())
        else:
            codes = np.sort(codes)
            cuts = [0, *np.searchsorted(codes, self.edges[1:]).tolist(), len(codes)]
            for container, a, b in zip(self.containers, cuts, cuts[1:], strict=False):
                if a < b:
                    container.update(codes[a:b].tolist())
        while any(len(c) > self.burst and self._divide(k) for k, c in enumerate(self.containers)):
            pass

    def _divide(self, k: int) -> bool:
        """Divides container k at the word boundary nearest to its middle; false if it holds one prefix of two words only."""
        keys = np.sort(np.fromiter(self.containers[k], np.int64, len(self.containers[k])))
        for level in (2 * ID_BITS, ID_BITS):
            prefixes = keys >> level
            if prefixes[0] != prefixes[-1]:
                middle = prefixes[len(prefixes) // 2]
                at = int(middle if middle != prefixes[0] else prefixes[np.searchsorted(prefixes, middle, "right")]) << level
                low, high = Counter(), Counter()
                for code, n in self.containers[k].items():
                    (low if code < at else high)[code] = n
                self.containers[k : k + 1] = [low, high]
                self.edges = np.insert(self.edges, k + 1, at)
                return True
        return False

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties whole subtrees, the largest first, until at most keep entries stay: (codes, counts), sorted by code."""
        left = len(self)
        for k in sorted(range(len(self.containers)), key=lambda k: -len(self.containers[k])):
            c = self.containers[k]
            if left <= keep or not c:
                return
            left -= len(c)
            codes, counts = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
            c.clear()
            order = np.argsort(codes)
            yield codes[order], counts[order]
