"""Suffix arrays by induced sorting in numpy, and permuted common prefixes.

Suffixes are classified as smaller or larger than their right neighbour. The substrings between leftmost
smaller positions are sorted by one induction and named; if names repeat, the string of names is sorted by
doubled prefixes (its alphabet is large, so an induction over it would go in batches of few positions); a second
induction then places all suffixes. An induction scans the array in batches: a batch may be as long as nothing
that it places falls inside it, so whole buckets are handled by a few array operations.
"""

from __future__ import annotations

import numpy as np

_FIRST, _MOST = 256, 1 << 18
#: A batch that is cut to at most this many positions is in a run of one symbol or a short period; such
#: stretches are walked one position at a time.
_STUCK, _WALK = 4, 64


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; ``t`` ends with a unique least symbol."""
    n = len(t)
    out = np.ones(n, bool)
    up = t[:-1] < t[1:]
    change = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.repeat(change, np.diff(np.append(-1, change)))
    out[: len(nxt)] = up[nxt]
    return out


def _place(c: np.ndarray, pos: np.ndarray, slot: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable slots of symbols ``c`` counted from ``slot[c]`` in direction ``step``: slots, positions, symbols, counts."""
    order = np.argsort(c, kind="stable")
    cs, ps = c[order], pos[order]
    new = np.empty(len(cs), bool)
    new[0] = True
    np.not_equal(cs[1:], cs[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    counts = np.empty(len(heads), np.int64)
    np.subtract(heads[1:], heads[:-1], out=counts[:-1])
    counts[-1] = len(cs) - heads[-1]
    kinds = cs[heads]
    # The slot of an element: its group's slot, moved on by its place in the group.
    base = slot[kinds] - heads if step > 0 else slot[kinds] + heads
    dest = np.repeat(base, counts)
    index = np.arange(len(cs))
    return (dest + index if step > 0 else dest - index), ps, kinds, counts


def _induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from leftmost-smaller positions in the given order."""
    n = len(t)
    coded = t * t.dtype.type(2) + small  # a symbol and its class in one look-up
    sa = np.full(n, -1, np.int32)
    starts = np.append(0, ends[:-1])
    dest, ps, _, _ = _place(t[lms[::-1]], lms[::-1], ends - 1, -1)
    sa[dest] = ps
    # Larger suffixes, from the left.
    slot, at, size, walk = starts.copy(), 0, _FIRST, _WALK
    while at < n:
        end = min(n, at + size)
        from_ = np.flatnonzero(sa[at:end] > 0)
        j = sa[at:end][from_] - 1
        c = coded[j]
        larger = (c & 1) == 0
        j, c = j[larger], c[larger] >> 1
        if len(j):
            dest, ps, cs, counts = _place(c, j, slot, 1)
            low = int(dest.min())
            if low < end and low - at <= _STUCK:
                end = min(n, at + walk)
                for i in range(at, end):
                    k = int(sa[i]) - 1
                    if k >= 0 and not small[k]:
                        c = t[k]
                        sa[slot[c]] = k
                        slot[c] += 1
                at, size, walk = end, _FIRST, min(_MOST, 2 * walk)
                continue
            walk = _WALK
            if low < end:
                size = max(8, low - at)
                end = low
                j = j[: np.searchsorted(from_[larger], end - at)]
                if len(j):
                    dest, ps, cs, counts = _place(c[: len(j)], j, slot, 1)
            if len(j):
                sa[dest] = ps
                slot[cs] += counts
        at = end
        size = min(_MOST, 2 * size)
    # Smaller suffixes, from the right; the seeds go first, since all of them are induced again.
    seeds = sa > 0
    seeds[seeds] = small[sa[seeds]]
    sa[seeds] = -1
    sa[0] = n - 1
    slot, at, size, walk = ends - 1, n, _FIRST, _WALK
    while at > 0:
        begin = max(0, at - size)
        s = sa[begin:at][::-1]
        from_ = np.flatnonzero(s > 0)
        j = s[from_] - 1
        c = coded[j]
        smaller = (c & 1) == 1
        j, c = j[smaller], c[smaller] >> 1
        if len(j):
            dest, ps, cs, counts = _place(c, j, slot, -1)
            high = int(dest.max())
            if high >= begin and at - high - 1 <= _STUCK:
                begin = max(0, at - walk)
                for i in range(at - 1, begin - 1, -1):
                    k = int(sa[i]) - 1
                    if k >= 0 and small[k]:
                        c = t[k]
                        sa[slot[c]] = k
                        slot[c] -= 1
                at, size, walk = begin, _FIRST, min(_MOST, 2 * walk)
                continue
            walk = _WALK
            if high >= begin:
                size = max(8, at - high - 1)
                begin = high + 1
                j = j[: np.searchsorted(from_[smaller], at - begin)]
                if len(j):
                    dest, ps, cs, counts = _place(c[: len(j)], j, slot, -1)
            if len(j):
                sa[dest] = ps
                slot[cs] -= counts
        at = begin
        size = min(_MOST, 2 * size)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of names, the last of which is the unique least one, by ranks of prefixes of 1, 2, 4 ... names.

    A rank is the first place of its group; only groups of several suffixes are sorted again.
    """
    n = len(names)
    order, rank = np.arange(n), np.empty(n, np.int64)
    at, key, span = np.arange(n), names.astype(np.int64), 1
    while len(at):
        by = np.argsort(key)
        p, key = order[at][by], key[by]
        order[at] = p
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(heads, len(at)))
        rank[p] = np.repeat(at[heads], counts)
        several = np.repeat(counts > 1, counts)
        at, p = at[several], p[several]
        key = rank[p] * n + rank[p + span]  # equal prefixes end before the last name, which is unique
        span *= 2
    return order


def _sort(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is the unique least one, 0."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    if symbols < 1 << 15:
        t = t.astype(np.uint16)  # small symbols are sorted by radix
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(t, minlength=symbols))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(t, small, ends, lms)
    order = sa[is_lms[sa]]
    # Name equal substrings alike: same length and same symbols up to the next leftmost-smaller position.
    length = np.zeros(n, np.int32)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    length[n - 1] = 1
    same = length[order[1:]] == length[order[:-1]]
    live, off = np.flatnonzero(same), 0
    while len(live):
        a, b = order[live] + off, order[live + 1] + off
        differ = t[a] != t[b]
        same[live[differ]] = False
        off += 1
        live = live[~differ & (length[order[live]] > off)]
    name = np.empty(n, np.int32)
    name[order] = np.append(0, np.cumsum(~same))
    reduced = name[lms]
    if int(name[order[-1]]) + 1 < len(lms):
        order = lms[_doubled(reduced)]
    return _induce(t, small, ends, order)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a uint8 array in order."""
    if not len(text):
        return np.empty(0, np.int32)
    t = np.zeros(len(text) + 1, np.int32)
    t[:-1] = text
    t[:-1] += 1
    return _sort(t, 257)[1:]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position (zeros after the end), as one integer; the first byte is lowest."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,)).copy()


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix with the one before it in ``sa``.

    The value at a position is one less than at the position to its left, unless the two compared suffixes
    are preceded by different bytes; only those positions are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    phi = np.empty(n, np.int32)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    compare = np.ones(n, bool)
    inner = phi[1:] > 0
    compare[1:][inner] = text[:-1][inner] != text[phi[1:][inner] - 1]
    at = np.flatnonzero(compare)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    word = _words(text)
    off = 0
    while len(live):
        a, b = at[live] + off, phi[at[live]] + off
        room = n - np.maximum(a, b)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        # Equal bytes at the low end of the difference; a difference of 0 has eight.
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) / 8).astype(np.int64))
        equal = np.minimum(equal, np.maximum(room, 0))
        value[live] += equal
        live = live[equal == 8]
        off += 8
    last = np.maximum.accumulate(np.where(compare, np.arange(n), 0))
    index = np.cumsum(compare) - 1
    return value[index] - (np.arange(n) - last)
