"""Grammars of repeated pairs over many short sequences, and the periodic stretches of what their rules derive; in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: A run holds so many of its periods, and so many symbols, at least.
LEAST_PERIODS, LEAST_LENGTH = 4, 6
#: Repeated pairs are replaced until a round shortens the sequence by less than this share; what is left is paired as it stands.
LEAST_GAIN = 0.02
_PRIME = np.uint64((1 << 31) - 1)
_BASE, _FACTOR = np.uint64(0x2545F4914F6CDD1D), np.uint64(1_103_515_245)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Hashes of all stretches of a sequence, by two moduli, 2**64 and a prime of 31 bits."""

    def __init__(self, t: np.ndarray) -> None:
        n = len(t)
        h = (t.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        self.wide = np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _BASE)])
        np.multiply.accumulate(self.wide, out=self.wide)
        self.narrow = _powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * self.wide[:n])])
        self.rests = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((h % _PRIME) * self.narrow[:n] % _PRIME)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` from a and from b, a <= b, are the same."""
        apart = b - a
        x, y = self.sums[a + size] - self.sums[a], self.sums[b + size] - self.sums[b]
        same = x * self.wide[apart] == y
        x, y = (self.rests[a + size] - self.rests[a]) % _PRIME, (self.rests[b + size] - self.rests[b]) % _PRIME
        return same & (x * self.narrow[apart] % _PRIME == y)

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from a and from b on (`back`: before a and b) are the same, up to `most`; a <= b."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _powers(n: int) -> np.ndarray:
    """Powers of _FACTOR modulo _PRIME."""
    out = np.ones(n, dtype=np.uint64)
    size, step = 1, _FACTOR
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step % _PRIME
        size, step = 2 * size, step * step % _PRIME
    return out


@dataclass
class Rules:
    """Rules made at once: of each the place and length of one derivation, the length of its left part, and where all its derivations stand."""

    start: np.ndarray
    length: np.ndarray
    left: np.ndarray
    parts: np.ndarray  # the symbols of the two parts
    first: int  # number of the first of these rules
    places: np.ndarray  # of all derivations
    of_place: np.ndarray  # and their rules, counted from 0


def rules(t: np.ndarray, ends: np.ndarray) -> Iterator[Rules]:
    """Re-Pair over the sequences of `t` that end at `ends` (none empty): the rules in an order in which their parts come first.

    A round replaces the pairs that occur more than once, the more frequent of two overlapping ones; of three and more equal symbols every second pair. Once
    little repeats, neighbours are paired until each sequence is one symbol, so that every boundary within a sequence is a rule's.
    """
    symbols, count = np.unique(t, return_inverse=True)
    sequence, made = count.astype(np.int64), len(symbols)
    at, size = np.arange(len(t)), np.ones(len(t), dtype=np.int64)
    sequence_of = np.searchsorted(ends, at, side="right")
    repeating = True
    while True:
        joined = sequence_of[1:] == sequence_of[:-1]
        if not joined.any():
            return
        if repeating:
            pairs = np.where(joined, sequence[:-1] * made + sequence[1:], -1 - np.arange(len(joined)))
            known, kind, times = np.unique(pairs, return_inverse=True, return_counts=True)
            weight = np.where(joined & (times[kind] > 1), times[kind] * len(known) + kind, -1)
            chosen = _chosen(weight)
            repeating = len(chosen) > LEAST_GAIN * len(sequence)
        if not repeating:
            begins = np.flatnonzero(np.append(True, ~joined))
            within = np.arange(len(sequence)) - np.repeat(begins, np.diff(np.append(begins, len(sequence))))
            chosen = np.flatnonzero(joined & (within[:-1] % 2 == 0))
        codes = sequence[chosen] * made + sequence[chosen + 1]
        _, one, which = np.unique(codes, return_index=True, return_inverse=True)
        some = chosen[one]
        yield Rules(at[some], size[some] + size[some + 1], size[some], np.stack([sequence[some], sequence[some + 1]], axis=1), made, at[chosen], which)
        sequence[chosen] = made + which
        made += len(some)
        size[chosen] += size[chosen + 1]
        stay = np.ones(len(sequence), dtype=bool)
        stay[chosen + 1] = False
        sequence, at, size, sequence_of = sequence[stay], at[stay], size[stay], sequence_of[stay]


def _chosen(weight: np.ndarray) -> np.ndarray:
    """Places whose weight is over those to the left and right, and every second of a row of equal ones."""
    n = len(weight)
    begins = np.flatnonzero(np.append(True, weight[1:] != weight[:-1]))
    sizes = np.diff(np.append(begins, n))
    values = weight[begins]
    edges = np.concatenate([[-1], values, [-1]])
    over = (values >= 0) & (values > edges[:-2]) & (values > edges[2:])
    begins, sizes = begins[over], sizes[over]
    half = (sizes + 1) // 2
    first = np.cumsum(half) - half
    return np.repeat(begins - 2 * first, half) + 2 * np.arange(int(half.sum()))


def runs(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the sequences of `t` that end at `ends`, by start and then period.

    A run is a longest stretch with smallest period q, of LEAST_PERIODS * q symbols and LEAST_LENGTH at least. Its lowest rule holds it whole, and
    one side of that rule's boundary holds two periods: q is the root of a square at the beginning of the right part or at
    the end of the left part. Each rule keeps these roots of both its ends, and computes the runs over its boundary once, however often it is derived.
    They are translated to all its derivations; a stretch that goes on beyond its rule is part of a longer one from a rule above, and is dropped.
    """
    ends = np.unique(ends[np.diff(np.append(0, ends)) > 0]) if len(ends) else ends
    none = np.zeros(0, dtype=np.int64)
    if len(t) == 0:
        return none, none, none
    hashes = Hashes(t)
    heads, tails = _Roots(), _Roots()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in rules(t, ends):
        border, end, right = r.start + r.left, r.start + r.length, r.length - r.left
        # Runs over the boundary, from the roots of the parts.
        rule, q = heads.of(r.parts[:, 1])
        forth = hashes.shared(border[rule], border[rule] + q, right[rule] - q)
        back = hashes.shared(border[rule], border[rule] + q, r.left[rule], back=True)
        crossing = [(rule, q, border[rule] - back, border[rule] + q + forth)]
        rule, q = tails.of(r.parts[:, 0])
        back = hashes.shared(border[rule] - q, border[rule], r.left[rule] - q, back=True)
        forth = hashes.shared(border[rule] - q, border[rule], right[rule])
        crossing.append((rule, q, border[rule] - q - back, border[rule] + forth))
        rule, q, begin, stop = (np.concatenate(x) for x in zip(*crossing))
        enough = stop - begin >= np.maximum(LEAST_PERIODS * q, LEAST_LENGTH)
        if enough.any():
            found.append(_derived(r, rule[enough], q[enough], begin[enough], stop[enough]))
        # Roots at the rule's own ends: those of its parts, and squares that reach over the boundary.
        rule, q = _lengths(r.left // 2 + 1, r.length // 2)
        square = t[r.start[rule]] == t[r.start[rule] + q]
        rule, q = rule[square], q[square]
        square = hashes.equal(r.start[rule], r.start[rule] + q, q)
        rule, q = (np.concatenate(x) for x in zip(heads.of(r.parts[:, 0]), (rule[square], q[square])))
        reach = hashes.shared(r.start[rule], r.start[rule] + q, r.length[rule] - q) + q
        heads.add(r.first, len(r.start), rule, q, reach)
        rule, q = _lengths(right // 2 + 1, r.length // 2)
        square = t[end[rule] - 1] == t[end[rule] - 1 - q]
        rule, q = rule[square], q[square]
        square = hashes.equal(end[rule] - 2 * q, end[rule] - q, q)
        rule, q = (np.concatenate(x) for x in zip(tails.of(r.parts[:, 1]), (rule[square], q[square])))
        reach = hashes.shared(end[rule] - q, end[rule], r.length[rule] - q, back=True) + q
        tails.add(r.first, len(r.start), rule, q, reach)
    if not found:
        return none, none, none
    return _merged(*(np.concatenate(x) for x in zip(*found)))


class _Roots:
    """The lengths q of the primitive squares at one end of what symbols derive; symbols are numbered as they are made, and those of the text have none."""

    def __init__(self) -> None:
        self.blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # first symbol, symbols, their first roots, roots

    def add(self, first: int, symbols: int, symbol: np.ndarray, q: np.ndarray, reach: np.ndarray) -> None:
        """Of equal reaches the least root counts: the others are its multiples."""
        order = np.lexsort((q, reach, symbol))
        symbol, q, reach = symbol[order], q[order], reach[order]
        least = np.ones(len(q), dtype=bool)
        least[1:] = (symbol[1:] != symbol[:-1]) | (reach[1:] != reach[:-1])
        symbol, q = symbol[least], q[least]
        if len(q):
            self.blocks.append((first, symbols, np.searchsorted(symbol, np.arange(symbols + 1)), q))

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `symbols`, root) for all their roots."""
        rows, roots = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for first, size, begins, q in self.blocks:
            at = np.flatnonzero((symbols >= first) & (symbols < first + size))
            number = symbols[at] - first
            many = begins[number + 1] - begins[number]
            rows.append(np.repeat(at, many))
            roots.append(q[np.repeat(begins[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
        return np.concatenate(rows), np.concatenate(roots)


def _lengths(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for low, low + 1, … high of each row."""
    many = np.maximum(high - low + 1, 0)
    rows = np.repeat(np.arange(len(low)), many)
    return rows, np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _derived(r: Rules, rule: np.ndarray, q: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rules' runs at all places where the rules are derived."""
    order = np.argsort(rule, kind="stable")
    rule, q, begin, stop = rule[order], q[order], begin[order], stop[order]
    low, high = np.searchsorted(rule, r.of_place, side="left"), np.searchsorted(rule, r.of_place, side="right")
    place, run = _lengths(low, high - 1)
    moved = r.places[place] - r.start[rule[run]]
    return begin[run] + moved, stop[run] + moved, q[run]


def _merged(begin: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that no other of the same period holds, each with its smallest period."""
    order = np.lexsort((-stop, begin, q))
    begin, stop, q = begin[order], stop[order], q[order]
    group = np.cumsum(np.append(0, q[1:] != q[:-1])) * (int(stop.max()) + 1)  # periods one behind the other on a line
    reach = np.maximum.accumulate(stop + group)
    new = np.append(True, (stop + group)[1:] > reach[:-1])
    begin, stop, q = begin[new], stop[new], q[new]
    order = np.lexsort((q, stop, begin))
    begin, stop, q = begin[order], stop[order], q[order]
    least = np.append(True, (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1]))
    begin, stop, q = begin[least], stop[least], q[least]
    order = np.lexsort((q, begin))
    return begin[order], stop[order], q[order]
