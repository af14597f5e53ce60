"""The ratio of `difflib.SequenceMatcher` for two texts, its numbers unchanged, by searches of whole substrings."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

#: From this length of the second text on, difflib starts no match at its frequent characters.
MANY = 200

Longest = Callable[[str, str, int, int, int, int], tuple[int, int, int]]


def matching_ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(): twice the characters in matching blocks, over all characters."""
    if not a and not b:
        return 1.0
    longest = of_rare_characters(a, b) if len(b) >= MANY else longest_common
    matched, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        i, j, n = longest(a, b, alo, ahi, blo, bhi)
        if n:
            matched += n
            if alo < i and blo < j:
                parts.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                parts.append((i + n, ahi, j + n, bhi))
    return 2.0 * matched / (len(a) + len(b))


def longest_common(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest text common to a[alo:ahi] and b[blo:bhi]; of equals the first in a, then in b.

    Each place of the shorter part asks the longer part only for a text that would be better than the best so far.
    """
    a_shorter = ahi - alo <= bhi - blo
    s, t = (a[alo:ahi], b[blo:bhi]) if a_shorter else (b[blo:bhi], a[alo:ahi])
    size, k, n, s_at, t_at = len(s), 0, 0, 0, 0
    # places of a come in order, so that equals are no better; places of b do not, so that an equal may be earlier in a
    while k + (need := n + a_shorter or 1) <= size:
        at = t.find(s[k : k + need])
        if at >= 0:
            while k + need < size and (farther := t.find(s[k : k + need + 1], at)) >= 0:
                at, need = farther, need + 1
            if need > n or at < t_at:
                s_at, t_at, n = k, at, need
        k += 1
    return (alo + s_at, blo + t_at, n) if a_shorter else (alo + t_at, blo + s_at, n)


def of_rare_characters(a: str, b: str) -> Longest:
    """As longest_common, but matches start from characters that make up no more than about 1% of b; then they grow to both sides by any.

    Only the places of such characters are gone through, which are few in prose.
    """
    most = len(b) // 100 + 1
    found: dict[str, list[int]] = {c: [] for c, n in Counter(b).items() if n <= most}
    for j, c in enumerate(b):
        if c in found:
            found[c].append(j)
    starts = [i for i, c in enumerate(a) if c in found]
    places = [found[a[i]] for i in starts]

    def longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        i, j, n = alo, blo, 0
        runs, last = {}, -2  # lengths of matches that end at the last place in a, by their end in b
        for at, js in zip(starts[(s := bisect_left(starts, alo)) : (e := bisect_left(starts, ahi))], places[s:e]):
            before, runs = runs if at == last + 1 else {}, {}
            last = at
            for k in js if js[0] >= blo else js[bisect_left(js, blo) :]:
                if k >= bhi:
                    break
                m = runs[k] = before.get(k - 1, 0) + 1
                if m > n:
                    i, j, n = at - m + 1, k - m + 1, m
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return i, j, n

    return longest
