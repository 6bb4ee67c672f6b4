"""The suffix automaton of a set of words: which words end at each place of a text.

Its states are the classes of substrings of the words that end at the same places of them.  Reading a text keeps the longest suffix
of what was read that is such a substring; the words that end here are those of its state, and of the states along its suffix links.
It is kept as flat arrays: of a few bytes for each edge and state, so that it can be sent to every worker.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass


@dataclass
class SuffixAutomaton:
    """labels, target: each state's edges from first[state] on; link, longest: its suffix link and longest substring;
    own: the words (number, length) of the states that have any."""

    labels: bytes
    target: array
    first: array
    link: array
    longest: array
    own: dict[int, list[tuple[int, int]]]

    def words_of(self, state: int) -> tuple[tuple[int, int], ...]:
        """The words of the state and of those along its suffix links."""
        out: list[tuple[int, int]] = []
        while state > 0:
            out += self.own.get(state, ())
            state = self.link[state]
        return tuple(out)


def build(words: dict[bytes, int]) -> SuffixAutomaton:
    """words: each word's number.  Shorter prefixes come first, so no substring is met before it is a word's prefix or a part of one."""
    edges: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    state_of = {b"": 0}
    for prefix in sorted({w[:n] for w in words for n in range(1, len(w) + 1)}, key=len):
        c, at, own = prefix[-1], state_of[prefix[:-1]], len(edges)
        edges.append({})
        longest.append(longest[at] + 1)
        link.append(0)
        state_of[prefix] = own
        while at >= 0 and c not in edges[at]:
            edges[at][c] = own
            at = link[at]
        if at >= 0:
            met = edges[at][c]
            if longest[met] > longest[at] + 1:
                split = len(edges)
                edges.append(dict(edges[met]))
                longest.append(longest[at] + 1)
                link.append(link[met])
                link[met] = split
                while at >= 0 and edges[at].get(c) == met:
                    edges[at][c] = split
                    at = link[at]
                met = split
            link[own] = met
    own_words: dict[int, list[tuple[int, int]]] = {}
    for w, n in words.items():
        state = state_of[w]
        while longest[link[state]] >= len(w):
            state = link[state]
        own_words.setdefault(state, []).append((n, len(w)))
    first, target, labels = array("i", [0]), array("i"), bytearray()
    for e in edges:
        labels.extend(e.keys())
        target.extend(e.values())
        first.append(len(target))
    return SuffixAutomaton(bytes(labels), target, first, array("i", [max(x, 0) for x in link]), array("i", longest), own_words)
