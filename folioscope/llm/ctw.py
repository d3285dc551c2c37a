"""Context-tree weighting over bytes, on sorted arrays of grams.

A byte is eight binary decisions, each with a context tree of its own: the decision's
context is the bytes before it, nearest first. A node estimates its decision by
Krichevsky-Trofimov from the training counts and mixes this with what its children
say, weighted by how well either coded the training data, so that all depths take part.
A node that the training has not seen tells nothing: there its nearest seen ancestor
ends the path.

A gram is a 64-bit number: the context, nearest byte first, and the byte itself last.
The end of a text is a symbol (byte 255, which no UTF-8 text has), as is the missing
context at its start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

#: Context bytes: with the byte itself they fill the 64 bits of a gram.
DEPTH = 7
END = 255

_EMPTY, _HALF_BITS = ~np.uint64(0), np.uint64(32)
_HALF = math.lgamma(0.5)
_TWO = math.log(2)


def _log_gamma_table(plus: float, size: int = 1 << 16) -> np.ndarray:
    return np.concatenate([[math.lgamma(plus)], math.lgamma(plus) + np.cumsum(np.log(np.arange(size - 1) + plus))])


_TABLES = {plus: _log_gamma_table(plus) for plus in (0.5, 1.0)}


def _log_gamma(x: np.ndarray, plus: float) -> np.ndarray:
    """Of integers plus a half or one: a table, and Stirling's series beyond it."""
    table = _TABLES[plus]
    small = x < len(table)
    out = table[np.where(small, x, 0)]
    if not small.all():
        z = x[~small] + plus
        out[~small] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z)
    return out


def joined(texts: list[bytes]) -> np.ndarray:
    """All texts in one array: the end of a text is also the missing context of the next."""
    pad = bytes([END]) * DEPTH
    return np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)


def grams(texts: list[bytes]) -> np.ndarray:
    """The grams of all places of the texts and of their ends, in order (a text of n bytes has n + 1)."""
    data = joined(texts)
    out = np.zeros(len(data) - DEPTH, np.uint64)
    for d in range(1, DEPTH + 1):
        out = (out << np.uint64(8)) | data[DEPTH - d : len(data) - d]
    out = (out << np.uint64(8)) | data[DEPTH:]
    # Between two texts only the first end is a symbol; the rest is padding.
    ends = np.flatnonzero(data[DEPTH:] == END)
    keep = np.ones(len(out), bool)
    keep[ends[np.arange(len(ends)) % DEPTH > 0]] = False
    return out[keep]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several counts (each of sorted distinct keys) and their sums."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    counts = np.zeros(len(keys), np.int64)
    for own, n in parts:
        counts[np.searchsorted(keys, own)] += n
    return keys, counts


class Table:
    """32-bit values of distinct keys under a hash, for lookups of keys that it is known to hold.

    A slot holds 32 further bits of the hash and the value; keys that find their slot
    taken go to the next, smaller table. ``parts`` gives the keys and values piece by
    piece, as often as it is called, ``size`` is their number.
    """

    def __init__(self, size: int, parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]):
        self.tables: list[tuple[int, np.uint64, np.ndarray]] = []
        factor = np.uint64(0x9E3779B97F4A7C15)
        while size:
            bits = max(4, int(1.2 * size).bit_length())
            table, left = self._filled(bits, factor, parts())
            factor = factor * np.uint64(5)
            if left is not None:  # else two keys have the same slot and bits
                self.tables.append((bits, self.factor, table))
                size, parts = sum(len(k) for k, _ in left), lambda left=left: left

    def _filled(self, bits: int, factor: np.uint64, parts: Iterable[tuple[np.ndarray, np.ndarray]]):
        self.factor = factor
        table, left = np.full(1 << bits, _EMPTY), []
        for keys, values in parts:
            slot, entry = self._parts(keys * factor, bits)
            entry |= values
            free = table[slot] == _EMPTY
            table[slot[free]] = entry[free]
            other = table[slot] ^ entry
            taken = other >> _HALF_BITS > 0
            if (other[~taken] > 0).any():
                return table, None
            left.append((keys[taken], values[taken]))
        return table, left

    @staticmethod
    def _parts(mixed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return (mixed >> np.uint64(64 - bits)).astype(np.int64), (mixed << np.uint64(bits)) >> _HALF_BITS << _HALF_BITS

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint32)
        at = None
        for bits, factor, table in self.tables:
            slot, entry = self._parts(keys * factor, bits)
            found = table[slot]
            right = (found ^ entry) >> _HALF_BITS == 0
            out[np.flatnonzero(right) if at is None else at[right]] = found[right].astype(np.uint32)
            at = np.flatnonzero(~right) if at is None else at[~right]
            keys = keys[~right]
        return out


@dataclass
class _Level:
    """Keys of one depth (context bytes and the byte), their counts, and the place of each key's parent one level up."""

    keys: np.ndarray
    counts: np.ndarray
    up: np.ndarray | None = None


@dataclass
class _Nodes:
    """The nodes of one decision at one depth: runs of keys that share context and leading bits."""

    starts: np.ndarray
    run: np.ndarray
    total: np.ndarray
    chance: np.ndarray
    weighted: np.ndarray
    share: np.ndarray = field(default=None)


class Segment:
    """The trees over sorted ``keys`` from their depth ``rise`` levels up.

    ``weights`` (8 rows, one a decision) are the weighted log probabilities of the
    deepest nodes where these have children of their own, outside the segment.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rise: int, weights: np.ndarray | None = None):
        self.levels = [_Level(keys, counts)]
        self.weights = weights
        for _ in range(rise):
            last = self.levels[-1]
            above = (last.keys >> np.uint64(16) << np.uint64(8)) | (last.keys & np.uint64(255))
            up, last.up = np.unique(above, return_inverse=True)
            self.levels.append(_Level(up, np.bincount(last.up, last.counts, len(up)).astype(np.int64)))

    def _nodes(self, decision: int) -> list[_Nodes]:
        out: list[_Nodes] = []
        for depth, level in enumerate(self.levels):
            leading = level.keys >> np.uint64(8 - decision)
            first = np.concatenate([[True], leading[1:] != leading[:-1]])
            starts = np.flatnonzero(first)
            total = np.add.reduceat(level.counts, starts)
            one = np.add.reduceat(level.counts * self._bits(level, decision), starts)
            own = _log_gamma(one, 0.5) + _log_gamma(total - one, 0.5) - 2 * _HALF - _log_gamma(total, 1.0)
            nodes = _Nodes(starts, np.cumsum(first) - 1, total, (one + 0.5) / (total + 1), own, np.ones(len(starts)))
            if depth:
                child = out[-1]
                below = np.bincount(nodes.run[self.levels[depth - 1].up[child.starts]], child.weighted, len(starts))
                nodes.weighted = np.logaddexp(own, below) - _TWO
                nodes.share = np.exp(own - _TWO - nodes.weighted)
            elif self.weights is not None:
                nodes.weighted = self.weights[decision][starts]
            out.append(nodes)
        return out

    @staticmethod
    def _bits(level: _Level, decision: int) -> np.ndarray:
        return ((level.keys >> np.uint64(7 - decision)) & np.uint64(1)).astype(np.int64)

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, counts and weights of the segment's highest level."""
        weights = []
        for decision in range(8):
            nodes = self._nodes(decision)[-1]
            weights.append(nodes.weighted[nodes.run])
        return self.levels[-1].keys, self.levels[-1].counts, np.stack(weights)

    def _fall(self, decision: int, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What reaches the deepest nodes from above, and the chance of a one there, both by key.

        ``above`` (three rows) says the same of the highest nodes: the chance that the
        shallower ones give so far, the weight left for deeper ones, and the chance if
        the path ended above. Without it the highest nodes are the roots.
        """
        nodes = self._nodes(decision)
        reach = None
        for depth in range(len(nodes) - 1, -1, -1):
            now = nodes[depth]
            if reach is None:
                root = np.repeat([[0.0], [1.0], [0.5]], len(now.starts), axis=1)
                arrived = root if above is None else above[:, now.starts]
            else:
                arrived = reach[:, nodes[depth + 1].run[self.levels[depth].up[now.starts]]]
            given, left, ended = arrived
            chance = np.where(now.total > 0, given + left * now.chance, ended)
            reach = np.stack([given + left * now.share * now.chance, left * (1 - now.share), chance])
        return arrived[:, now.run], chance[now.run]

    def arrive(self, above: np.ndarray | None = None) -> np.ndarray:
        """What reaches the nodes of the deepest level: decisions by three by keys, to be the ``above`` of a segment below."""
        return np.stack([self._fall(w, None if above is None else above[w])[0] for w in range(8)])

    def logs(self, above: np.ndarray | None = None) -> np.ndarray:
        """Log10 probability of each key's byte in its context."""
        out = np.zeros(len(self.levels[0].keys))
        for decision in range(8):
            chance = np.clip(self._fall(decision, None if above is None else above[decision])[1], 1e-15, 1 - 1e-15)
            out += np.log10(np.where(self._bits(self.levels[0], decision) > 0, chance, 1 - chance))
        return out
