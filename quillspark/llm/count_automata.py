"""Weighted acyclic automata over words: an n-gram of 1 to 3 words is a path, and the weight of its last arc is its count.

States with equal arcs (word, weight, target) are one state. An automaton holds its own sorted table of words, so it means the same
wherever it goes. All steps are array operations: an automaton is built from sorted n-grams block by block, each block freezing the
states whose prefix it completes; several are united by listing their paths in a common table of words and adding weights up;
looking many n-grams up at once is a composition of their automaton with the counting one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

NARROW = (1 << 21) - 1
BLOCK_KEYS = 1 << 19
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_table(words: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Distinct words in order of their bytes."""
    each = pc.unique(words)
    return each.take(pc.array_sort_indices(each))


def total_counts(keys: np.ndarray, weights: np.ndarray | None, size: int, narrow: int = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys (three word numbers, 0 for none, at most size) in order, and the sums of their weights (1 each without any)."""
    if not len(keys):
        return keys.reshape(0, 3), np.zeros(0, np.int64)
    pairs = None
    if size < narrow:
        key = keys[:, 0] << 42 | keys[:, 1] << 21 | keys[:, 2]
    else:
        pairs, which = np.unique(keys[:, 0] << 32 | keys[:, 1], return_inverse=True)
        key = which.astype(np.int64) << 32 | keys[:, 2]
    if weights is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, weights = key[order], weights[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    totals = np.diff(np.r_[start, len(key)]) if weights is None else np.add.reduceat(weights, start)
    key = key[start]
    if pairs is None:
        out = np.stack([key >> 42, key >> 21 & NARROW, key & NARROW], 1)
    else:
        pair = pairs[key >> 32]
        out = np.stack([pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF], 1)
    return out, totals.astype(np.int64)


class States:
    """Frozen states of one depth, each kept once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def freeze(self, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Numbers of the states whose arcs begin at `first`; the ones not seen before are added."""
        if not len(first):
            return np.zeros(0, np.int64)
        marks = [np.add.reduceat(mix(label.astype(np.uint64) * s + mix(weight.astype(np.uint64) + s) + mix(target.astype(np.uint64) ^ s)), first) for s in _SALT]
        order = np.lexsort(marks)
        new = np.r_[True, (marks[0][order][1:] != marks[0][order][:-1]) | (marks[1][order][1:] != marks[1][order][:-1])]
        group = np.empty(len(first), np.int64)
        group[order] = np.cumsum(new) - 1
        heads = order[new]
        number, fresh = np.empty(len(heads), np.int64), []
        for k, mark in enumerate(zip(marks[0][heads].tolist(), marks[1][heads].tolist())):
            at = self.known.get(mark)
            if at is None:
                at = self.known[mark] = len(self.known)
                fresh.append(heads[k])
            number[k] = at
        if fresh:
            keep = np.array(fresh)
            size = np.diff(np.r_[first, len(label)])[keep]
            arcs = spread(first[keep], size)
            self.parts.append((size, label[arcs], weight[arcs], target[arcs]))
        return number[group]

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)] if self.parts else [np.zeros(0, np.int64) for _ in range(4)]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] places, then the next."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Builder:
    """Takes n-grams in order. A word's n-grams come in one block."""

    def __init__(self) -> None:
        self.inner, self.last, self.root = States(), States(), []

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        pair_new = np.r_[True, (keys[1:, 0] != keys[:-1, 0]) | (keys[1:, 1] != keys[:-1, 1])]
        word_new = np.r_[True, keys[1:, 0] != keys[:-1, 0]]
        # arcs to words in third place, by pair
        third = keys[:, 2] > 0
        pair = np.cumsum(pair_new) - 1
        owner = pair[third]
        below = np.full(int(pair[-1]) + 1, -1, np.int64)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        none = np.full(int(third.sum()), -1, np.int64)
        below[owner[start]] = self.last.freeze(start, keys[third, 2], weights[third], none)
        # arcs to words in second place, by word; a pair without a count of its own has weight 0
        head = np.flatnonzero(pair_new)
        second = keys[head, 1] > 0
        count = np.where(keys[head, 2] == 0, weights[head], 0)
        word = (np.cumsum(word_new) - 1)[head]
        owner = word[second]
        under = np.full(int(word[-1]) + 1, -1, np.int64)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        under[owner[start]] = self.inner.freeze(start, keys[head, 1][second], count[second], below[second])
        head = np.flatnonzero(word_new)
        alone = (keys[head, 1] == 0) & (keys[head, 2] == 0)
        self.root.append((keys[head, 0], np.where(alone, weights[head], 0), under))

    def done(self) -> list[list[np.ndarray]]:
        root = [np.concatenate(x) for x in zip(*self.root)] if self.root else [np.zeros(0, np.int64)] * 3
        return [[np.array([len(root[0])]), *root], self.inner.arrays(), self.last.arrays()]


class Automaton:
    """words: table in order; levels: for each depth the states' numbers of arcs, and the arcs' words (from 1), weights and targets."""

    def __init__(self, words: pa.Array, levels: list[list[np.ndarray]]):
        self.words, self.levels = words, levels
        self.first = [np.cumsum(x[0]) - x[0] for x in levels]

    @classmethod
    def build(cls, words: pa.Array, keys: np.ndarray, weights: np.ndarray) -> Automaton:
        """From distinct n-grams in order; the words that none of them has are left out of the table."""
        used = np.unique(keys)
        used = used[used > 0]
        place = np.zeros(len(words) + 1, np.int64)
        place[used] = np.arange(1, len(used) + 1)
        keys = place[keys]
        out = Builder()
        edges = np.flatnonzero(np.r_[True, keys[1:, 0] != keys[:-1, 0]]) if len(keys) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(keys):
            at = np.searchsorted(edges, lo + BLOCK_KEYS)
            hi = int(edges[at]) if at < len(edges) else len(keys)
            out.add(keys[lo:hi], weights[lo:hi])
            lo = hi
        return cls(words.take(pa.array(used - 1)), out.done())

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams as rows of word numbers, by length, and their counts."""
        keys, weights = [], []
        state, prefix = np.zeros(1, np.int64), np.zeros((1, 3), np.int64)
        for depth, (size, label, weight, target) in enumerate(self.levels):
            n = size[state]
            arcs = spread(self.first[depth][state], n)
            prefix = np.repeat(prefix, n, axis=0)
            prefix[:, depth] = label[arcs]
            real = weight[arcs] > 0
            keys.append(prefix[real])
            weights.append(weight[arcs][real])
            on = target[arcs] >= 0
            state, prefix = target[arcs][on], prefix[on]
        return np.concatenate(keys), np.concatenate(weights)

    def compose(self, asked: Automaton) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of asked that this automaton has too, in word numbers of asked, and their counts here."""
        number = np.concatenate(([0], pc.fill_null(pc.index_in(asked.words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        keys, weights = [], []
        ours, theirs, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 3), np.int64)
        for depth, ((size, label, weight, target), (a_size, a_label, a_weight, a_target)) in enumerate(zip(self.levels, asked.levels)):
            n = a_size[theirs]
            a_arcs = spread(asked.first[depth][theirs], n)
            want = np.repeat(ours, n) << 32 | number[a_label[a_arcs]]
            prefix = np.repeat(prefix, n, axis=0)
            prefix[:, depth] = a_label[a_arcs]
            have = np.repeat(np.arange(len(size)), size) << 32 | label
            arcs = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            met = have[arcs] == want if len(have) else np.zeros(len(want), bool)
            arcs, a_arcs, prefix = arcs[met], a_arcs[met], prefix[met]
            real = (weight[arcs] > 0) & (a_weight[a_arcs] > 0)
            keys.append(prefix[real])
            weights.append(weight[arcs][real])
            on = (target[arcs] >= 0) & (a_target[a_arcs] >= 0)
            ours, theirs, prefix = target[arcs][on], a_target[a_arcs][on], prefix[on]
        return np.concatenate(keys), np.concatenate(weights)

    def dump(self) -> bytes:
        text = self.words.cast(pa.large_binary())
        parts = [np.diff(np.frombuffer(text.buffers()[1], "<i8")[text.offset : text.offset + len(text) + 1]) if len(text) else np.zeros(0, np.int64)]
        parts += [x for level in self.levels for x in level]
        joined = b"".join(text.to_pylist())
        body = [struct.pack("<14q", len(joined), *(len(x) for x in parts)), joined]
        for x in parts:  # byte places apart: high places of small numbers compress to nothing
            body.append(np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes())
        data = b"".join(body)
        return struct.pack("<q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        (size,) = struct.unpack_from("<q", data)
        raw = pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd", asbytes=True)
        text, *sizes = struct.unpack_from("<14q", raw)
        at, parts = 14 * 8 + text, []
        for n in sizes:
            parts.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(n))
            at += 8 * n
        offsets = np.concatenate(([0], np.cumsum(parts[0]))).astype("<i8")
        words = pa.Array.from_buffers(pa.large_binary(), len(parts[0]), [None, pa.py_buffer(offsets), pa.py_buffer(raw[14 * 8 : 14 * 8 + text])])
        return cls(words, [parts[1:5], parts[5:9], parts[9:13]])


def united(own: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(table of words, distinct n-grams in order, counts added up) of several such; the list is emptied on the way."""
    words = words_table(pa.chunked_array([w for w, _, _ in own], pa.large_binary()))
    weights = np.concatenate([n for _, _, n in own]) if own else np.zeros(0, np.int64)
    keys = np.zeros((len(weights), 3), np.int64)
    at = 0
    for k, (w, mine, _) in enumerate(own):
        number = np.concatenate(([0], pc.index_in(w, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        keys[at : at + len(mine)] = number[mine]
        at += len(mine)
        own[k] = ()
    return words, *total_counts(keys, weights, len(words))


def unite(bodies: list[bytes], least: int = 1) -> Automaton:
    """All n-grams of several dumped automata with their counts added up; those of a smaller count than `least` are left out.

    One automaton at a time is opened; what stays of it are its words and its paths in narrow numbers.
    """
    own = []
    for data in bodies:
        a = Automaton.load(data)
        keys, counts = a.paths()
        own.append((a.words, keys.astype(np.int32), counts))
        del a, keys
    words, keys, totals = united(own)
    keep = totals >= least
    return Automaton.build(words, keys[keep], totals[keep])
