"""Which n-grams may be frequent: a pass of counts by hash before the automata, so that rare n-grams are neither built nor sent.

Every task counts the hashes of its n-grams, in slots of segments of about `SEGMENT_BYTES` of text each. A segment adds its slots up and gives back one bit
block, in which slots of at least `least` leave a mark. An n-gram without a mark is rarer than `least` for certain; one with a mark is counted exactly
later on, so what meets by chance only costs work. All blocks together have at most `BITS` bits, whatever the text; on more than about 10 GB
of text they fill up and rule out less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix, word_hashes

SEGMENT_BYTES = 32 << 20
SLOTS, BLOCK_BITS, BITS = 24, 1 << 20, 1 << 28
HELD_HASHES = 6 << 20
MOST = 200  # counts from here on are all the same
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one, two and three words that begin at each of these words (given by their hashes)."""
    one = mix(words ^ np.uint64(int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")))
    two = mix(one[:-1] * _STEP + one[1:])
    return one, two, mix(two[:-1] * _STEP + one[2:])


class Likely:
    """The marks: blocks of `width` bits, one for each segment."""

    def __init__(self, segments: int, width: int, bits: np.ndarray):
        self.segments, self.width, self.bits = segments, width, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        segment, slot = place(hashes, self.segments)
        bit = segment * np.uint64(self.width) + (slot * np.uint64(self.width) >> np.uint64(SLOTS))
        return (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def place(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32), hashes & np.uint64((1 << SLOTS) - 1)


def _counted(places: np.ndarray, most: int) -> np.ndarray:
    """Places as numbers (place << 8 | count) in order, each once."""
    places.sort()
    start = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, np.int64)
    n = np.minimum(np.diff(np.r_[start, len(places)]), most).astype(np.uint64)
    return places[start] << np.uint64(8) | n


def _added(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Such numbers of several parts, each place once."""
    x = np.sort(np.concatenate(parts))
    start = np.flatnonzero(np.r_[True, x[1:] >> np.uint64(8) != x[:-1] >> np.uint64(8)]) if len(x) else np.zeros(0, np.int64)
    n = np.minimum(np.add.reduceat(x & np.uint64(255), start), np.uint64(most)) if len(x) else x
    return x[start] >> np.uint64(8) << np.uint64(8) | n


def likely(docs: DataFrame, shards: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], least: int, segment_bytes: int = SEGMENT_BYTES) -> Likely | None:
    """The marks of docs (text, lang); None where all n-grams are frequent enough. shards: (lang, bytes, starts and ends of words,
    whether the next word is of the same piece) of a task's rows."""
    if least < 2:
        return None
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-text // segment_bytes))
    width = max(8, min(BLOCK_BITS, BITS // segments) // 8 * 8)
    most = min(least, MOST)

    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        x = _added(held, most)
        segment = (x >> np.uint64(8 + SLOTS)).astype(np.int64)
        low = (x & np.uint64((1 << 32) - 1)).astype("<u4")
        own = np.unique(segment)
        cuts = np.searchsorted(segment, np.append(own, segments))
        # byte places apart, as neighbours share the high ones
        bodies = [low[lo:hi].view(np.uint8).reshape(-1, 4).T.tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(bodies, pa.binary())], ["segment", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, raw, starts, ends, near in shards(batches):
            if not len(starts):
                continue
            one, two, three = gram_hashes(word_hashes(raw, starts, ends), lang)
            segment, slot = place(np.concatenate([one, two[near], three[near[1:] & near[:-1]]]), segments)
            held.append(_counted(segment << np.uint64(SLOTS) | slot, most))
            size += len(held[-1])
            del one, two, three, segment, slot
            if size >= HELD_HASHES:
                yield give(held)
                held, size = [], 0
                give_back()
        if size:
            yield give(held)
        give_back()

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slots = np.zeros(1 << SLOTS, np.uint16)
        for body in pdf["body"]:
            x = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
            at = x >> 8
            slots[at] = np.minimum(slots[at] + (x & 255).astype(np.uint16), most)
        marks = np.zeros(width, bool)
        marks[np.flatnonzero(slots >= most) * width >> SLOTS] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    bits = np.zeros((segments, width // 8), np.uint8)
    for r in docs.mapInArrow(run, "segment long, body binary").groupBy("segment").applyInPandas(block, "segment long, bits binary").collect():
        bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Likely(segments, width, bits.reshape(-1))
