"""Word sets of texts and the compact signatures made of them, vectorised over Arrow batches.

A text's words are the distinct runs of ASCII letters, digits and underscores in its lower-cased form.
Every word becomes a 64-bit hash; everything below works on the flat array of those hashes.
"""

from __future__ import annotations

import re
from math import floor

import numpy as np
import pyarrow as pa
import xxhash

_WORD = re.compile("[a-z0-9_]+")
#: Words kept in a task's hash cache; it is emptied beyond that, so its memory is bounded.
CACHE_WORDS = 500_000


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text; empty for null."""
    return set(_WORD.findall(text.lower())) if text else set()


class WordHasher:
    """Hashes the words of many texts; keeps the hashes of words seen before."""

    def __init__(self) -> None:
        self._cache: dict[str, int] = {}

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all distinct words of all texts, number of words of each text)."""
        cache, digest, find = self._cache, xxhash.xxh64_intdigest, _WORD.findall
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = set(find(text.lower()))
            for w in words:
                h = cache.get(w)
                if h is None:
                    h = cache[w] = digest(w)
                out.append(h)
            counts[i] = len(words)
        return np.array(out, dtype=np.uint64), counts


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def set_hash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An order-free 64-bit hash of each word set. All counts must be positive."""
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(mix64(hashes), _starts(counts)) + counts.astype(np.uint64))


def parity_map(hashes: np.ndarray, counts: np.ndarray, bits: int = 64) -> np.ndarray:
    """Parity map of ``bits`` bits (a power of two up to 64) of each set: every word flips one bit.

    Two sets whose symmetric difference has d words have maps that differ in at most d bits, so the
    popcount of the xor bounds the difference from below without the words. All counts must be positive.
    """
    return np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(bits - 1)), _starts(counts))


class SizeClasses:
    """Size classes for a self-join at threshold ``t``, with the most words that similar sets of a class differ in.

    Class i holds the set sizes ``low[i] .. high[i]``. Two sets can be similar only if they are in one class or in
    neighbouring ones; a set near its class's upper end also takes part in the next class.
    """

    def __init__(self, t: float, least: int, growth: float = 1.3) -> None:
        self.t, self.least, self.growth = t, least, growth
        self.low: list[int] = [least]
        self.high: list[int] = [max(least, floor(least * growth))]
        self.differ: list[int] = [self._differ(self.high[0])]

    def _differ(self, high: int) -> int:
        return floor((1 - self.t) / (1 + self.t) * 2 * high + 1e-9)

    def reach(self, size: int) -> None:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], floor(self.low[-1] * max(self.growth, 1 / self.t))))
            self.differ.append(self._differ(self.high[-1]))

    def reach_beyond(self, size: int) -> None:
        """Also the class after that of ``size``: its sets may be in other batches or tasks only."""
        self.reach(size)
        self.reach(self.high[-1] + 1 if self.low[-1] <= size else size)


class Prefixes:
    """The prefixes of a batch of sets, one entry per (set, class it takes part in).

    ``of``: the set's row; ``own``: whether the class is the set's own; ``keys`` and ``n_keys``: the flat 64-bit
    prefix hashes and their number per entry; ``wide`` and ``n_wide``: the same of the 32-bit block hashes that
    lengthen a prefix.
    """

    def __init__(self, of: np.ndarray, own: np.ndarray, keys: np.ndarray, n_keys: np.ndarray, wide: np.ndarray, n_wide: np.ndarray) -> None:
        self.of, self.own, self.keys, self.n_keys, self.wide, self.n_wide = of, own, keys, n_keys, wide, n_wide


def _slot_sums(values: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of every slot, modulo 2^64."""
    sums = np.zeros(n, dtype=np.uint64)
    if len(slots):
        by = np.argsort(slots, kind="stable")
        s = slots[by]
        heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        with np.errstate(over="ignore"):
            sums[s[heads]] = np.add.reduceat(values[by], heads)
    return sums


def _tagged(sums: np.ndarray, classes: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        tag = (classes.astype(np.uint64) * np.uint64(65_537) + number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(sums ^ tag)


def prefixes(hashes: np.ndarray, counts: np.ndarray, classes: SizeClasses) -> Prefixes:
    """Prefix keys of every set, in every class that it takes part in.

    Similar sets of a class differ in at most d words. The token universe is cut by hash into (d + 1) // 2 double
    blocks of three parts each and, if d is even, one single block: if every double block held two differing words
    or more and the single one held one, they would be d + 1. So two similar sets agree in a single block, or in
    two of three parts of a double block. A prefix of an order that lists one of these unions first is just that
    union; its key hashes (class, order, words). The parts are sized so that all prefixes have about equal lengths.

    ``wide`` cuts the universe anew into d + 1 blocks, of which similar sets share one: appending each of them to a
    prefix gives longer prefixes that still find all similar sets.
    """
    none = np.zeros(0, np.int64)
    if not len(counts):
        return Prefixes(none, none.astype(bool), none, none, none.astype(np.int32), none)
    classes.reach_beyond(int(counts.max()))
    low, high, differ = map(np.array, (classes.low, classes.high, classes.differ))
    own = np.searchsorted(high, counts, side="left")
    also = counts >= np.ceil(classes.t * low[own + 1] - 1e-9)
    of = np.concatenate([np.arange(len(counts)), np.flatnonzero(also)])
    is_own = np.arange(len(of)) < len(counts)
    cls = np.concatenate([own, own[also] + 1])
    d = differ[cls]
    double, single = (d + 1) // 2, (d + 1) % 2
    # Words of every entry: the flat hashes of its set.
    n = counts[of]
    entry = np.repeat(np.arange(len(of)), n)
    at = np.repeat(_starts(counts)[of], n) + (np.arange(len(entry)) - np.repeat(_starts(n), n))
    h = hashes[at]
    mixed = mix64(h)
    unit = (h >> np.uint64(32)).astype(np.float64) / 2**32
    place = np.minimum((unit * (3 * double + 2 * single)[entry]).astype(np.int64), (3 * double + 2 * single)[entry] - 1)
    part = np.minimum(place, (3 * double)[entry])  # what is beyond the double blocks' parts is the single block
    parts = 3 * double + single
    first = _starts(parts)
    sums = _slot_sums(mixed, first[entry] + part, int(parts.sum()))
    keys = np.zeros(len(sums), np.uint64)
    part_entry = np.repeat(np.arange(len(of)), parts)
    number = np.arange(len(sums)) - first[part_entry]
    within = number < 3 * double[part_entry]
    mate = np.where(within, number - number % 3 + (number + 1) % 3, number)  # the next of the three parts
    with np.errstate(over="ignore"):
        keys = np.where(within, sums + sums[first[part_entry] + mate], sums)
    keys = _tagged(keys, cls[part_entry], number)
    blocks = d + 1
    wide_first = _starts(blocks)
    other = mix64(h ^ np.uint64(0xA5A5_5A5A_1234_8765))
    slot = wide_first[entry] + (other >> np.uint64(20)).astype(np.int64) % blocks[entry]
    wide_sums = _slot_sums(other, slot, int(blocks.sum()))
    wide_entry = np.repeat(np.arange(len(of)), blocks)
    wide = _tagged(wide_sums, cls[wide_entry], np.arange(len(wide_sums)) - wide_first[wide_entry])
    return Prefixes(of, is_own, keys.view(np.int64), parts, (wide >> np.uint64(32)).astype(np.uint32).view(np.int32), blocks)


def tree_labels(hashes: np.ndarray, counts: np.ndarray, trees: int, levels: int, first_bits: int, more_bits: int, group: np.ndarray) -> np.ndarray:
    """Labels of a hash forest: non-negative uint64 [sets, trees].

    The highest ``first_bits`` bits hash the set's ``group``, the tree and the first minimum hash, then come
    ``more_bits`` bits of every further one: sets of a group that agree in their first d minimum hashes are
    neighbours in the sorted order of the labels.
    """
    n = len(counts)
    labels = np.zeros((n, trees), dtype=np.uint64)
    if not n:
        return labels
    starts = _starts(counts)
    rng = np.random.default_rng(20_177)
    for tree in range(trees):
        for level in range(levels):
            odd, add = rng.integers(1, 2**63, size=2, dtype=np.uint64)
            with np.errstate(over="ignore"):
                x = (hashes ^ add) * (odd | np.uint64(1))
                x ^= x >> np.uint64(29)
                least = mix64(np.minimum.reduceat(x, starts))
                if level == 0:
                    labels[:, tree] = mix64(least ^ (group + np.uint64(tree + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - first_bits)
                else:
                    labels[:, tree] = (labels[:, tree] << np.uint64(more_bits)) | (least >> np.uint64(64 - more_bits))
    return labels


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of flat values and list lengths."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, type=kind))
