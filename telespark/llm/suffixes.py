"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of fewer than 2**31 bytes; in numpy."""

from __future__ import annotations

import numpy as np

#: Names of leftmost-smaller substrings are sorted by induction again while they are so few; more of them tell almost all places apart already.
FEW_NAMES = 1 / 32


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `t` (integers of 0 or more) in order; a suffix that is the beginning of another comes before it.

    Places are classified as smaller (S) or larger (L) than their right neighbours' suffixes. The substrings between leftmost S places are
    sorted by one induction and named, the string of names is sorted by recursion, and a second induction puts all suffixes in order. An induction handles
    a bucket of equal first symbols at a time, so that its steps are array operations; each suffix is moved once.
    """
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller(t)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(leftmost) == 0:
        return _induced(t, small, leftmost)
    by_symbol = leftmost[np.argsort(t[leftmost], kind="stable")]
    marked = np.zeros(n, dtype=bool)
    marked[leftmost] = True
    rough = _induced(t, small, by_symbol)
    names = _names(t, leftmost, rough[marked[rough]])
    most = int(names.max()) + 1
    if most == len(names):
        order = np.argsort(names)
    elif most <= len(names) * FEW_NAMES:
        order = suffix_array(names)
    else:
        order = _doubled(names)
    return _induced(t, small, leftmost[order])


def _smaller(t: np.ndarray) -> np.ndarray:
    """Where a suffix is smaller than the next one. The last is larger than the empty suffix behind it."""
    n = len(t)
    decided = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the next place with an unequal neighbour
    less = np.append(t[:-1] < t[1:], False)
    return np.append(less[decided], False)


def _induced(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost S ones in order (or, for the order of their substrings alone, by first symbol)."""
    n = len(t)
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.empty(n, dtype=np.int32)
    symbols = np.flatnonzero(counts)
    firsts = np.searchsorted(t[leftmost], np.arange(len(counts) + 1)) if len(leftmost) else np.zeros(len(counts) + 1, dtype=np.int64)
    head, tail = starts.copy(), ends.copy()

    def place(found: np.ndarray, kind: bool, at: np.ndarray, step: int) -> None:
        """Puts the left neighbours of that type to the next free slots of their buckets."""
        left = found[found > 0] - 1
        left = left[small[left] == kind]
        if len(left) == 0:
            return
        symbol = t[left]
        order = np.argsort(symbol, kind="stable")
        left, symbol = left[order], symbol[order]
        begins = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        sizes, keys = np.diff(np.append(begins, len(left))), symbol[begins]
        within = np.arange(len(left)) - np.repeat(begins, sizes)
        slots = np.repeat(at[keys], sizes) + within if step > 0 else np.repeat(at[keys] - 1, sizes) - within
        sa[slots] = left
        at[keys] += step * sizes

    sa[head[t[-1]]] = n - 1
    head[t[-1]] += 1
    for c in symbols:
        done = starts[c]
        while done < head[c]:  # neighbours of the same symbol come into this bucket too
            found, done = sa[done : head[c]], head[c]
            place(found, False, head, 1)
        place(leftmost[firsts[c] : firsts[c + 1]], False, head, 1)
    for c in symbols[::-1]:
        done = ends[c]
        while tail[c] < done:
            found, done = sa[tail[c] : done][::-1], tail[c]
            place(found, True, tail, -1)
        place(sa[starts[c] : head[c]][::-1], True, tail, -1)
    return sa


def _names(t: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost S place to the next, in the order of the text; equal ones share a rank."""
    length = np.zeros(len(t), dtype=np.int32)
    length[leftmost] = np.diff(np.append(leftmost, len(t))) + 1
    a, b = ordered[:-1], ordered[1:]
    equal = (length[a] == length[b]) & (a != leftmost[-1]) & (b != leftmost[-1])  # the last one ends with the text
    active, at = np.flatnonzero(equal), 0
    while len(active):
        same = t[a[active] + at] == t[b[active] + at]
        equal[active[~same]] = False
        at += 1
        active = active[same & (length[a[active]] > at)]
    rank = np.zeros(len(t), dtype=np.int32)
    rank[ordered] = np.append(0, np.cumsum(~equal))
    return rank[leftmost]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of which most places are told apart soon: ranks of twice as many names in each round, for the places that still share one."""
    n, most, reach = len(names), int(names.max()) + 2, 1
    keys = names.astype(np.int64) + 1
    while reach < n and most ** (reach + 1) < 1 << 62:  # as many names at first as fit
        keys = keys * most
        keys[: n - reach] += names[reach:] + 1
        reach += 1
    order = np.argsort(keys)
    rank, active, old = np.zeros(n, dtype=np.int64), order, np.zeros(n, dtype=np.int64)
    keys = keys[order]
    while True:
        # A rank is the number of smaller places; places with equal keys share it.
        at = np.arange(len(active))
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.append(True, old[1:] != old[:-1])
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        active = active[~(new & np.append(new[1:], True))]
        if len(active) == 0:
            break
        old = rank[active]
        keys = old * (n + 1)
        inside = active + reach < n
        keys[inside] += rank[active[inside] + reach] + 1
        order = np.argsort(keys)
        active, old, keys = active[order], old[order], keys[order]
        reach *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as an integer; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype="<u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the bytes `t` how many bytes its suffix shares with the one before it in `sa`; 0 for the first.

    Where the bytes to the left of both are equal, it is one less than the value to the left. Only the other places are compared.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    unlike = np.append(True, t[:-1] != t[np.maximum(before[1:] - 1, 0)])
    place = np.flatnonzero((before == 0) | ((before > 0) & unlike)).astype(np.int32)
    other = before[place]
    words = words_at(t)
    shared = np.zeros(len(place), dtype=np.int32)
    active = np.arange(len(place), dtype=np.int32)
    while len(active):
        x, y = place[active] + shared[active], other[active] + shared[active]
        inside = np.maximum(x, y) < n
        if not inside.all():
            active, x, y = active[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        low = differ & (~differ + np.uint64(1))
        shared[active] += np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8).astype(np.int32)
        active = active[differ == 0]
    shared = np.minimum(shared, n - np.maximum(place, other))
    prefixes = np.zeros(n, dtype=np.int32)
    prefixes[place] = shared + place
    np.maximum.accumulate(prefixes, out=prefixes)
    prefixes -= np.arange(n, dtype=np.int32)
    prefixes[sa[0]] = 0
    return np.maximum(prefixes, 0, out=prefixes)
