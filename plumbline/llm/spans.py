"""Spans found in texts: their text form and its digest, the same for every operator that reports spans."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

Span = tuple[str, int, int]


def spelled(spans: list[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then by the kind's place in order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def without_overlaps(found: list[Span], taken: list[Span]) -> list[Span]:
    """The found spans that share no character with a taken one; sorted starts and running ends make it one search for each."""
    if not taken or not found:
        return list(found)
    taken = sorted(taken, key=lambda s: s[1])
    starts = [a for _, a, _ in taken]
    ends = list(accumulate((b for _, _, b in taken), max))
    out = []
    for s in found:
        k = bisect_left(starts, s[2])
        if not k or ends[k - 1] <= s[1]:
            out.append(s)
    return out
