"""Packing examples into fixed-size training sequences: vector bin packing with the dot-product heuristic.

Every example asks for tokens, one segment, and loss-bearing tokens; every sequence offers at most `max_tokens`,
`max_segments` and `max_loss` of them. An example goes to that open sequence, among those it fits, whose free capacity has the
largest dot product with its demand, both in shares of the limits. Each task packs the rows it reads, so nothing shuffles.
An example longer than a sequence is cut: its whole sequences leave at once, the rest is packed. With `cut` set, open
sequences are topped up with parts of other examples, and what is left at the end of a task goes out as sequences whose
lengths are powers of two, which need no padding; so does a sequence that runs out of segments or loss-bearing tokens before it is full,
and the rest of it stays open.

Defined cases: null text is empty (its end token is packed alone); ids may be null or repeat, each row is packed by itself;
an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sub_batches, word_hashes, word_spans

MAX_TOKENS, MAX_SEGMENTS = 4096, 4096
END_ID = 2
OPEN_BINS = 48
# What a task holds besides its rows: so many words and pieces of words with their ids, about 30 MB each at most, so much text at
# once, and so many bytes of pieces that are ready to leave.
CACHE_WORDS, CACHE_PIECES = 400_000, 150_000
BATCH_BYTES, OUT_BYTES = 1 << 20, 1 << 21
ODD_SPACE = regex.compile(r"[^\S\n]")  # white space that does not end a word here, but does in the tokenizer


class WordTokens:
    """Ids by a word-level tokenizer (white space never joins words), with the words it has met kept in a bounded cache."""

    def __init__(self, path: str, most: int = CACHE_WORDS, most_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # the same model on pieces that are already normalised and split
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.bare.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        # the tokenizer's own split pattern (a fixed value)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.pieces: dict[str, bytes] = {}
        self.most, self.most_pieces = most, most_pieces
        self._forget()

    @functools.cached_property
    def whole(self):  # noqa: ANN201
        """The tokenizer as it is, for words that it may split or normalise in its own way."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        # words met before: their hashes in order, and where the ids of each are in `flat`
        self.keys, self.base, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word."""
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        text = "\n".join(words)
        odd = "<|" in text or ODD_SPACE.search(text)
        plain = [not (odd and ("<|" in w or ODD_SPACE.search(w))) for w in words]
        # the tokenizer lower-cases letter by letter, so a final sigma is like any other
        low = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower().split("\n")
        parts = []
        for w in low:
            if w.isalpha():
                parts.append((w,))
            elif w[-1] in ".," and w[:-1].isalpha():
                parts.append((w[:-1], w[-1]))
            else:
                parts.append(self.split.findall(w))
        new = list({x for p, ok in zip(parts, plain) if ok for x in p} - self.pieces.keys())
        for lo in range(0, len(new), 512):
            some = new[lo : lo + 512]
            ids = np.array(self.bare.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), 0
                for x, cut in zip(some, cuts.tolist()):
                    self.pieces[x] = raw[at:cut]
                    at = cut
            else:
                for x in some:
                    self.pieces[x] = np.array(self.bare.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.pieces
        return [b"".join([known[x] for x in p]) if ok else np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w, ok, p in zip(words, plain, parts)]

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the offsets of the rows."""
        starts, ends, first = word_spans(raw, bounds)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        if len(self.keys) > self.most:
            self._forget()
        hashes = word_hashes(raw, starts, ends)
        each, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, each)
        miss = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != each) if len(self.keys) else np.arange(len(each))
        if len(miss):
            fresh, sample, data = each[miss], sample[miss], raw.tobytes()
            got = self.words([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[sample].tolist(), ends[sample].tolist())])
            size = np.array([len(x) for x in got], np.int64) // 4
            into = np.searchsorted(self.keys, fresh)
            self.keys = np.insert(self.keys, into, fresh)
            self.base = np.insert(self.base, into, len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, into, size)
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(got), "<u4")))
            at = np.searchsorted(self.keys, each)
        at = at[which]
        n = self.size[at]
        stop = np.cumsum(n)
        take = np.arange(int(stop[-1])) + np.repeat(self.base[at] - (stop - n), n)
        return self.flat[take], np.concatenate(([0], stop))[first]


class Bins:
    """Open sequences of one task."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, tag: int):
        self.limits = np.array(limits, float)
        self.cut, self.tag, self.closed = cut, tag, 0
        self.free = np.zeros((0, 3))
        self.held: list[list[tuple]] = []

    def _name(self) -> int:
        self.closed += 1
        return (self.tag << 36) | self.closed

    def _pop(self, k: int) -> list[tuple]:
        pieces, self.held[k] = self.held[k], self.held[-1]
        self.free[k] = self.free[-1]
        self.held.pop()
        self.free = self.free[:-1]
        total = sum(p[2] for p in pieces)
        even = 1 << (total.bit_length() - 1)
        if not self.cut or total == even or total == int(self.limits[0]):
            return self._close(pieces)
        mine = self._first(pieces, even)
        self.held.append(pieces)
        self.free = np.vstack([self.free, self.limits - np.array([total - even, len(pieces), sum(p[3] for p in pieces)], float)])
        return self._close(mine)

    @staticmethod
    def _first(left: list[tuple], want: int) -> list[tuple]:
        """Takes the first `want` tokens out of these pieces."""
        mine = []
        while want:
            row, start, length, loss = left.pop(0)
            take = min(length, want)
            part = max(0, loss - (length - take))
            mine.append((row, start, take, part))
            if take < length:
                left.insert(0, (row, start + take, length - take, loss - part))
            want -= take
        return mine

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        name, at, out = self._name(), 0, []
        for p in pieces:
            out.append((*p, name, at))
            at += p[2]
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (row, start, length, loss). Returns the pieces of the sequences that this closes."""
        done = []
        _, _, length, loss = piece
        need = np.array([length, 1, loss], float)
        if len(self.held):
            fits = (self.free >= need).all(1)
            if fits.any():
                score = np.where(fits, (self.free / self.limits**2) @ need, -1.0)
                k = int(score.argmax())
                self.held[k].append(piece)
                self.free[k] -= need
                return self._pop(k) if self.free[k].min() < 1 else []
        while len(self.held) >= OPEN_BINS:
            done += self._relieve()
        self.held.append([piece])
        self.free = np.vstack([self.free, self.limits - need])
        if self.free[-1].min() < 1:
            done += self._pop(len(self.held) - 1)
        return done

    def _relieve(self) -> list[tuple]:
        """Closes the fullest sequence, topped up with the end of a piece of the emptiest if cutting is allowed."""
        full = int(self.free[:, 0].argmin())
        if not self.cut:
            return self._pop(full)
        while len(self.held) > 1 and self.free[full].min() >= 1:
            idle = np.where([bool(x) for x in self.held], self.free[:, 0], -1)
            idle[full] = -1
            donor = int(idle.argmax())
            if idle[donor] < 0:
                break
            row, start, length, loss = self.held[donor].pop()
            # the last `take` tokens of the piece, whose loss-bearing tokens are its last ones
            take = int(min(length, self.free[full, 0], self.free[full, 2] if loss else length))
            part = min(loss, take)
            self.held[full].append((row, start + length - take, take, part))
            self.free[full] -= (take, 1, part)
            self.free[donor] += (take, take == length, part)
            if take < length:
                self.held[donor].append((row, start, length - take, loss - part))
        done = self._pop(full)
        for k in [k for k, x in enumerate(self.held) if not x][::-1]:
            self.held.pop(k)
            self.free = np.delete(self.free, k, 0)
        return done

    def finish(self) -> list[tuple]:
        done = []
        if not self.cut:
            while self.held:
                done += self._pop(0)
            return done
        while len(self.held) > 1:
            done += self._relieve()
        if self.held:
            left, most = self.held.pop(), int(self.limits[0])
            self.free = self.free[:0]
            total = sum(p[2] for p in left)
            while total:
                want = min(most, 1 << (total.bit_length() - 1))
                total -= want
                done += self._close(self._first(left, want))
        return done


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_TOKENS,
    end_id: int = END_ID,
    cut: bool = True,
) -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids (little-endian 32-bit).

    loss_col: how many of an example's last tokens bear loss (null or absent: all). Without `cut`, only examples that exceed
    a sequence are cut. The limits hold at once in every sequence.
    """
    lead = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lead.alias("loss"))
    names = ["id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"]
    whole = min(max_tokens, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        bins = Bins((max_tokens, max_segments, max_loss), cut, context.partitionId() if context else 0)
        tokens = WordTokens(tokenizer_path)
        kept: dict[int, tuple] = {}  # row number -> id, ids, tokens; until its last piece is out
        number = 0

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for row, start, length, loss, sequence, at in pieces:
                entry = kept[row]
                for c, v in zip(cols, (entry[0], start, length, len(entry[1]), loss, sequence, at, entry[1][start : start + length].tobytes())):
                    c.append(v)
                entry[2] -= length
                if not entry[2]:
                    del kept[row]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names)

        for rows, raw, bounds in sub_batches(batches, "text", BATCH_BYTES):
            flat, offsets = tokens.rows(raw, bounds)
            out, held = [], 0
            for k, (doc, loss) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())):
                ids = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                kept[number] = [doc, ids, len(ids)]
                bears = len(ids) if loss is None else max(0, min(int(loss), len(ids)))
                free = len(ids) - bears
                for start in range(0, len(ids), whole):
                    length = min(whole, len(ids) - start)
                    done = bins.add((number, start, length, max(0, start + length - max(start, free))))
                    out += done
                    held += sum(4 * p[2] for p in done)
                    if held >= OUT_BYTES:
                        yield emit(out)
                        out, held = [], 0
                number += 1
            if out:
                yield emit(out)
        if rest := bins.finish():
            yield emit(rest)
        del tokens
        give_back()

    return rows.mapInArrow(run, "id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary")
