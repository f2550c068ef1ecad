"""Repeated substrings by prefix-free parsing: every byte covered by a string of `length` bytes that also starts in an earlier document.

Rolling-hash triggers parse each text into phrases. A trigger is the `WINDOW`-byte gram with the smallest rolling hash among
those of a `length`-byte string, so every such string has exactly one trigger, wherever it stands. The starts that
share a trigger are neighbours; the text that they cover is a phrase. Phrases overlap by length - 1 bytes, so no phrase is a prefix
of another one with the same trigger, and equal strings lie in phrases with equal triggers.

1. Triggers: each chunk of about `CHUNK_BYTES` of text sends its distinct triggers, in order and as differences, to the tasks that
   own them, and gets one bit back for each: whether other documents have it. Text that does not repeat goes no further.
2. Parse: the phrases of shared triggers go, as 128-bit names with their first document in the chunk, to their trigger's owner. The order of the
   parse need not reach beyond one phrase, as no string does. A phrase that an earlier document has is removed as a whole.
3. Dictionary: of phrases whose trigger also occurs in other phrases, each distinct one goes with its bytes to its trigger's owner, which
   builds the suffix array of its part of the dictionary, to a depth of `length` bytes and in order of bytes. In each run of
   equal suffixes the earliest document decides.

The answers are bits, in the order in which the chunk has asked. Chunks are dealt to partitions once and kept there on disk; only
questions and answers move.

Defined cases: null text is empty; a null id comes after all others and its own row gets a null id; rows that share an id
do not remove each other; texts shorter than `length` stay whole; a longer text than `CHUNK_BYTES` is a chunk of its own, parsed in
blocks; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLOCK, _BYTE, _DOWN, _UP, binary_view, give_back, hold, mix

LENGTH, WINDOW = 50, 32
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES, PART_BYTES = 1 << 21, 60_000, 24 << 20, 2 << 20
LAST = np.iinfo(np.int64).max
_OTHER = mix(_BYTE)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, size, ids, bounds, data): documents of a chunk in order of id, their texts end to end and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        tag = (context.partitionId() if context else 0) << 32
        held: list[tuple[int, bytes]] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            ids = np.array([x[0] for x in held], "<i8")
            bounds = np.concatenate(([0], np.cumsum([len(x[1]) for x in held]))).astype("<i8")
            data = pa.compress(b"".join(x[1] for x in held), codec="zstd", asbytes=True)
            cols = [pa.array([tag | number]), pa.array([int(bounds[-1])])] + [pa.array([x], pa.binary()) for x in (ids.tobytes(), bounds.tobytes(), data)]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "size", "ids", "bounds", "data"])

        for b in batches:
            raw, bounds = binary_view(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = raw[bounds[i] : bounds[i + 1]].tobytes()
                held.append((LAST if doc is None else doc, text))
                size += len(text)
                if size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, size long, ids binary, bounds binary, data binary")


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed byte place by byte place: high places of small numbers cost nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(n)


def _windows(raw: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of each `size` bytes of a block."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * _UP[: len(raw)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * _DOWN[: len(raw) - size + 1]


class Parse:
    """The phrases of one chunk: starts lo to hi of strings, trigger, two names, and the row of the document."""

    def __init__(self, ids: bytes, bounds: bytes, data: bytes, length: int):
        self.ids, self.bounds, self.length = np.frombuffer(ids, "<i8"), np.frombuffer(bounds, "<i8"), length
        total = int(self.bounds[-1])
        self.data = np.frombuffer(pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True) if total else b"", np.uint8)
        ok = np.zeros(total, bool)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            ok[a : max(a, b - length + 1)] = True
        step = _BLOCK - length
        parts = [self._block(at, ok[at : at + step]) for at in range(0, total, step)]
        parts = [p for p in parts if p is not None]
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        self.lo, self.hi, self.trigger, self.name, self.other = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds))
        self.doc = np.searchsorted(self.bounds, self.lo, "right") - 1

    def _block(self, at: int, ok: np.ndarray) -> tuple[np.ndarray, ...] | None:
        starts = np.flatnonzero(ok)
        if not len(starts):
            return None
        raw = self.data[at : at + len(ok) + self.length - 1]
        grams = mix(_windows(raw, _BYTE, WINDOW))
        place = np.uint64((1 << len(raw).bit_length()) - 1)
        low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        span, w = self.length - WINDOW + 1, 1
        while 2 * w <= span:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < span:
            low = np.minimum(low[: len(low) - (span - w)], low[span - w :])
        where = (low & place).astype(np.int64)[starts]
        # invalid starts lie between two texts, so a phrase never crosses them; it never crosses blocks either
        new = np.ones(len(starts), bool)
        new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        lo, hi = starts[head], starts[np.append(head[1:], len(starts)) - 1]
        names = []
        for k, table in enumerate((_BYTE, _OTHER)):
            whole = _windows(raw, table, self.length)
            names.append(mix(mix(whole[lo] + np.uint64(k)) + whole[hi] * np.uint64(3) + (hi - lo).astype(np.uint64)))
        return lo + at, hi + at, grams[where[head]], *names

    def triggers(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct triggers in order, whether several documents of the chunk have them, and which of them each phrase has."""
        short = self.trigger >> np.uint64(64 - bits)
        each, first, which = np.unique(short, return_index=True, return_inverse=True)
        many = np.zeros(len(each), bool)
        many[which[self.doc != self.doc[first][which]]] = True
        return each, many, which

    def phrases(self, shared: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, bucket, which): the distinct phrases that are shared, in order of bucket, by their first occurrence, and for each phrase
        its place among them or -1."""
        use = np.flatnonzero(shared)
        order = use[np.lexsort((use, self.other[use], self.name[use], self.trigger[use]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.name[order[1:]] != self.name[order[:-1]]) | (self.other[order[1:]] != self.other[order[:-1]])
        which = np.full(len(self.lo), -1, np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return first, _owner(self.trigger[first] >> np.uint64(64 - bits), buckets, bits), which


def _owner(short: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The range of triggers that each one falls into; bits is at most 48, buckets at most 2^16."""
    return ((short * np.uint64(buckets)) >> np.uint64(bits)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[lo]), lo, hi


def _flags(answers: pd.DataFrame, kind: int, n: int, bucket: np.ndarray) -> np.ndarray:
    """The answered bits of a chunk's questions, which are in order of bucket."""
    out = np.zeros(n, bool)
    told = {b: x for k, b, x in zip(answers["kind"].tolist(), answers["bucket"].tolist(), answers["bits"].tolist()) if k == kind}
    for b, lo, hi in _split(bucket):
        if b in told:
            out[lo:hi] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=hi - lo).astype(bool)
    return out


def _replies(pdf: pd.DataFrame, sizes: np.ndarray, **kinds: np.ndarray) -> pd.DataFrame:
    """Bits for each row of questions; rows without a set bit get none. kinds: k0, k1, ...: the bits of each kind for all rows end to end."""
    out: dict[str, list] = {"chunk": [], "kind": [], "bucket": [], "bits": []}
    ends = np.cumsum(sizes)
    for name, flag in kinds.items():
        for row, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            if flag[lo:hi].any():
                for c, v in zip(out.values(), (pdf["chunk"].iat[row], int(name[1:]), pdf["bucket"].iat[row], np.packbits(flag[lo:hi]).tobytes())):
                    c.append(v)
    return pd.DataFrame(out)


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which triggers of each chunk other chunks have too, or several documents of it."""
    sizes = pdf["n"].to_numpy()
    short = np.concatenate([np.cumsum(unpacked(x, n, "<u8")) for x, n in zip(pdf["steps"], sizes.tolist())])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["many"], sizes.tolist())]).astype(bool)
    by = np.argsort(short, kind="stable")
    start = np.flatnonzero(_runs(short[by]))
    more = np.repeat(np.diff(np.r_[start, len(by)]) > 1, np.diff(np.r_[start, len(by)]))
    many[by[more]] = True
    give_back()
    return _replies(pdf, sizes, k0=many)


def _earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kind 1: phrases that an earlier document has. Kind 2: others whose trigger several phrases share."""
    sizes = pdf["n"].to_numpy()
    tag, name, other, doc = (np.concatenate([unpacked(x, n, kind) for x, n in zip(pdf[c], sizes.tolist())]) for c, kind in (("tag", "<u4"), ("name", "<u8"), ("other", "<u8"), ("doc", "<i8")))
    by = np.lexsort((doc, other, name, tag))
    t, d = tag[by], doc[by]
    new = _runs(t, name[by], other[by])
    best = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.flatnonzero(_runs(t))
    size = np.diff(np.r_[group, len(t)])
    edge = np.repeat(np.maximum.reduceat(best, group) > np.minimum.reduceat(best, group), size)
    one, two = np.zeros(len(by), bool), np.zeros(len(by), bool)
    one[by] = best < d
    two[by] = edge & (best == d)
    give_back()
    return _replies(pdf, sizes, k1=one, k2=two)


def _suffixes(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Kind 3: of all suffixes of these phrases of the dictionary, in their order, those that an earlier document has."""
    widths = [unpacked(x, n, "<u4").astype(np.int64) for x, n in zip(pdf["widths"], pdf["n"].tolist())]
    text = np.frombuffer(b"".join(pa.decompress(x, decompressed_size=int(w.sum()), codec="zstd", asbytes=True) for x, w in zip(pdf["text"], widths)), np.uint8)
    tag, doc = (np.concatenate([unpacked(x, n, kind) for x, n in zip(pdf[c], pdf["n"].tolist())]) for c, kind in (("tag", "<u4"), ("doc", "<i8")))
    width = np.concatenate(widths)
    start, many = np.cumsum(width) - width, width - length + 1
    place = np.cumsum(many) - many
    again = np.zeros(int(many.sum()), bool)
    every = np.lib.stride_tricks.sliding_window_view(text, length)
    # phrases of one trigger stay together; so much text at once, as its suffixes take many times that
    parts = 1 + len(text) // PART_BYTES
    for part in range(parts):
        use = np.flatnonzero(tag % np.uint32(parts) == part)
        if not len(use):
            continue
        n = many[use]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        strings = every[np.repeat(start[use], n) + within].view(f"S{length}").reshape(-1)
        own = np.repeat(doc[use], n)
        order = np.argsort(strings, kind="stable")
        first = np.flatnonzero(_runs(strings[order]))
        best = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.r_[first, len(order)]))
        again[(np.repeat(place[use], n) + within)[order]] = best < own[order]
    del text, every
    give_back()
    return _replies(pdf, np.array([int((w - length + 1).sum()) for w in widths]), k3=again)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept): removed spans of bytes as an array of (start, end), and the bytes that stay. length: 40 to 100."""
    spark = docs.sparkSession
    table = hold(chunks(docs, id_col, text_col).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk"))
    total = table.select(F.sum("size")).first()[0] or 0
    buckets = min(1 << 16, max(8, -(-total // BUCKET_BYTES)))
    bits = min(48, max(24, int(total).bit_length() + 5))
    form = "chunk long, kind int, bucket long, bits binary"
    binary = lambda x: pa.array(x, pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                each, many, _ = Parse(r["ids"], r["bounds"], r["data"], length).triggers(bits)
                out = [(r["chunk"], n, hi - lo, packed(np.diff(each[lo:hi], prepend=np.uint64(0)).astype("<u8")), np.packbits(many[lo:hi]).tobytes()) for n, lo, hi in _split(_owner(each, buckets, bits))]
                if out:
                    chunk, bucket, n, steps, flags = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(bucket), pa.array(n), binary(steps), binary(flags)], ["chunk", "bucket", "n", "steps", "many"])
        give_back()

    asked = table.select("chunk", "ids", "bounds", "data").mapInArrow(ask, "chunk long, bucket long, n long, steps binary, many binary")
    shared = hold(asked.groupBy("bucket").applyInPandas(_shared, form))
    by_chunk = table.select("chunk", "ids", "bounds", "data").groupBy("chunk")

    def parsed(r: tuple, answers: pd.DataFrame) -> tuple[Parse, np.ndarray, np.ndarray, np.ndarray]:
        p = Parse(r.ids, r.bounds, r.data, length)
        each, _, which = p.triggers(bits)
        return p, *p.phrases(_flags(answers, 0, len(each), _owner(each, buckets, bits))[which], buckets, bits)

    def name(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("chunk", "bucket", "n", "tag", "name", "other", "doc")}
        for r in chunk.itertuples():
            p, first, bucket, _ = parsed(r, answers)
            tag, doc = (p.trigger[first] >> np.uint64(8)).astype("<u4"), p.ids[p.doc[first]].astype("<i8")
            for b, lo, hi in _split(bucket):
                at = first[lo:hi]
                for c, v in zip(out.values(), (r.chunk, b, hi - lo, packed(tag[lo:hi]), packed(p.name[at].astype("<u8")), packed(p.other[at].astype("<u8")), packed(doc[lo:hi]))):
                    c.append(v)
        give_back()
        return pd.DataFrame(out)

    names = by_chunk.cogroup(shared.groupBy("chunk")).applyInPandas(name, "chunk long, bucket long, n long, tag binary, name binary, other binary, doc binary")
    earlier = hold(names.groupBy("bucket").applyInPandas(_earlier, form))
    told = shared.unionByName(earlier)

    def look(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("chunk", "bucket", "n", "tag", "widths", "text", "doc")}
        for r in chunk.itertuples() if (answers["kind"] == 2).any() else ():
            p, first, bucket, _ = parsed(r, answers)
            use = np.flatnonzero(_flags(answers, 2, len(first), bucket))
            for b, lo, hi in _split(bucket[use]):
                at = first[use[lo:hi]]
                text = b"".join(p.data[a : c + length].tobytes() for a, c in zip(p.lo[at].tolist(), p.hi[at].tolist()))
                for c, v in zip(out.values(), (r.chunk, b, hi - lo, packed((p.trigger[at] >> np.uint64(8)).astype("<u4")), packed((p.hi[at] - p.lo[at] + length).astype("<u4")), pa.compress(text, codec="zstd", asbytes=True), packed(p.ids[p.doc[at]].astype("<i8")))):
                    c.append(v)
        give_back()
        return pd.DataFrame(out)

    inner = by_chunk.cogroup(told.groupBy("chunk")).applyInPandas(look, "chunk long, bucket long, n long, tag binary, widths binary, text binary, doc binary")
    suffixes = hold(inner.groupBy("bucket").applyInPandas(lambda pdf: _suffixes(pdf, length), form))

    def cut(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"id": [], "n_bytes": [], "spans": [], "kept": []}
        for r in chunk.itertuples():
            p, first, bucket, which = parsed(r, answers)
            covered = np.zeros(len(p.data) + 1, np.int32)

            def cover(lo: np.ndarray, hi: np.ndarray, covered: np.ndarray = covered) -> None:
                np.add.at(covered, lo, 1)
                np.add.at(covered, hi + length, -1)

            # a phrase goes if an earlier document has it, in another chunk or in this one
            own = np.flatnonzero(which >= 0)
            gone = _flags(answers, 1, len(first), bucket)[which[own]] | (p.ids[p.doc[own]] > p.ids[p.doc[first]][which[own]])
            cover(p.lo[own[gone]], p.hi[own[gone]])
            look = np.flatnonzero(_flags(answers, 2, len(first), bucket))
            many = (p.hi - p.lo + 1)[first[look]]
            suffix = np.repeat(look, many)
            again = np.flatnonzero(_flags(answers, 3, len(suffix), bucket[suffix]))
            start = p.lo[first[suffix]] + np.arange(len(suffix)) - np.repeat(np.cumsum(many) - many, many)
            cover(start[again], start[again])
            # rows that share the id of the first occurrence have the same suffixes
            twin = own[~gone & (own != first[which[own]])]
            if len(twin) and len(again):
                offset = defaultdict(list)
                for w, o in zip(suffix[again].tolist(), (start - p.lo[first[suffix]])[again].tolist()):
                    offset[w].append(o)
                for t in twin.tolist():
                    for o in offset.get(int(which[t]), ()):
                        cover(np.array([p.lo[t] + o]), np.array([p.lo[t] + o]))
            flag = np.cumsum(covered[:-1]) > 0
            for k, (a, b) in enumerate(zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist())):
                g = np.r_[False, flag[a:b], False]
                step = np.flatnonzero(g[1:] != g[:-1])
                out["id"].append(None if p.ids[k] == LAST else int(p.ids[k]))
                out["n_bytes"].append(b - a)
                out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(step[::2], step[1::2])])
                out["kept"].append(p.data[a:b][~g[1:-1]].tobytes())
        give_back()
        return pd.DataFrame(out).astype({"id": "Int64"})

    answers = told.unionByName(suffixes)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
