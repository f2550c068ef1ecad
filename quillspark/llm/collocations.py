"""Phrase collocation mining over weighted acyclic automata.

0. A pass of counts by hash tells which n-grams may reach `least` (`likely_grams`); the others are left out from here on.
1. Every task turns about `SHARD_BYTES` of text at a time into sorted n-grams of 1 to 3 words with counts, gathers up to `HELD_GRAMS` of
   them, cuts them at the borders of prefix ranges and builds one automaton for each range (`count_automata`).
2. The automata of a range are united and their weights added up. No part of a phrase is rarer than the phrase, so n-grams under
   `least` go for good from here on.
3. Each range lists its candidates and sends the automaton of their parts to the ranges that own them, which compose it with their own:
   out come the counts of the parts.
4. Scores, the weakest cut, candidates that a longer one covers and ranks are DataFrame operations over candidates.

Borders come from the n-grams of about `SAMPLE_DOCS` documents. They decide only how evenly work is dealt: ranges may begin inside the n-grams
of one word, so a frequent word is no hot key. A range stands for about `RANGE_BYTES` of text, not counting what the first pass ruled out.

Defined cases: null text is empty; a null lang is `und`; pieces are never cut, so memory follows the longest piece of text between two
separators; rows without id or with repeated ids all count (ids are not looked at); ties go to the phrase that is smaller in UTF-8
bytes; an empty table gives no rows; other columns are not looked at. Counts are exact below 10^15.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_view, give_back, lowered, settle, sub_batches, word_hashes
from .count_automata import Automaton, spread, total_counts, unite, united
from .likely_grams import Likely, gram_hashes, likely

SHARD_BYTES = 6 << 20
RANGE_BYTES = 12 << 20
HELD_GRAMS = 2 << 20
SAMPLE_DOCS, MARKS, MAX_RANGES = 2000, 64, 1 << 17
UNKNOWN = "und"

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased rows, end to end, and whether the next word is of the same piece (one less)."""
    ink = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    piece = np.cumsum(_CUT[raw] | edge[:-1], dtype=np.int32)[starts]
    return starts, np.flatnonzero(end) + 1, piece[1:] == piece[:-1]


def ngrams(raw: np.ndarray, bounds: np.ndarray, may: Likely | None = None, lang: str = UNKNOWN) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """(table of words, n-grams of 1 to 3 words in order, their counts, number of words) of lower-cased rows, end to end; without the n-grams
    that `may` rules out."""
    starts, ends, near = words_of(raw, bounds)
    n = len(starts)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros((0, 3), np.int64), np.zeros(0, np.int64), 0
    one, two, three = np.ones(n, bool), near, near[1:] & near[:-1]
    if may:
        marks = gram_hashes(word_hashes(raw, starts, ends), lang)
        one = may.holds(marks[0])
        two = two & one[1:] & one[:-1]
        two[two] = may.holds(marks[1][two])
        three = three & two[1:] & two[:-1]
        three[three] = may.holds(marks[2][three])
        del marks
    size = (ends - starts)[one]
    offsets = np.concatenate(([0], np.cumsum(size))).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[spread(starts[one], size)])]).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(1, len(order) + 1)
    w = np.zeros(n, np.int64)
    w[one] = number[words.indices.to_numpy()]
    every, totals = [], []
    for k, some in enumerate((one, two, three), 1):
        at = np.flatnonzero(some)
        grams = np.zeros((len(at), 3), np.int64)
        for i in range(k):
            grams[:, i] = w[at + i]
        got = total_counts(grams, None, len(order))
        every.append(got[0])
        totals.append(got[1])
    keys, counts = total_counts(np.concatenate(every), np.concatenate(totals), len(order))
    return words.dictionary.take(order), keys, counts, n


def _parts(raw: np.ndarray, bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in parts of about `most` bytes; a row that is longer ends its part at a separator."""
    lo, row = 0, 0
    while lo < len(raw):
        hi = min(lo + most, len(raw))
        row = int(np.searchsorted(bounds, hi, "right")) - 1
        if hi < len(raw) and bounds[row] > lo:
            hi = int(bounds[row])
        elif hi < len(raw):
            end = int(bounds[row + 1])
            cut = np.flatnonzero(_CUT[raw[hi:end]])
            hi = hi + int(cut[0]) + 1 if len(cut) else end
        inside = bounds[(bounds > lo) & (bounds < hi)]
        yield raw[lo:hi], np.concatenate(([lo], inside, [hi])) - lo
        lo = hi


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, bounds): texts of a task by language, gathered up to about `most` bytes."""
    held: dict[str, list[pa.Array]] = defaultdict(list)
    size = 0

    def give() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, texts in held.items():
            raw, bounds = binary_view(pa.concat_arrays(texts))
            for part, edges in _parts(lowered(raw), bounds, most):
                yield lang, part, edges

    for rows, raw, _ in sub_batches(batches, "text", most):
        langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        texts = rows.column(rows.schema.get_field_index("text")).cast(pa.large_binary())
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            held[lang].append(texts.filter(pc.equal(langs.indices, k)))
        size += len(raw)
        if size >= most:
            yield from give()
            held.clear()
            size = 0
    yield from give()


def _words(table: pa.Array, key: np.ndarray) -> tuple[bytes, ...]:
    return tuple(table[int(k) - 1].as_py() for k in key if k)


def borders(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, range_bytes: int = RANGE_BYTES, max_ranges: int = MAX_RANGES, may: Broadcast | None = None) -> dict[str, list[tuple[bytes, ...]]]:
    """For each language the n-grams at which prefix ranges begin, from a sample of about sample_docs of docs (text, lang). Text counts as far as
    its n-grams are not ruled out."""
    total = docs.count()
    rate = min(1.0, sample_docs / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw, bounds in _by_lang(batches, SHARD_BYTES):
            table, keys, counts, n = ngrams(raw, bounds, may and may.value, lang)
            size = len(raw) * counts.sum() / max(3 * n, 1)
            at = np.unique(np.linspace(0, len(keys) - 1, min(len(keys), MARKS)).astype(int)) if len(keys) else []
            for k in at:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([list(_words(table, keys[k]))], pa.list_(pa.binary())), pa.array([size / len(at)])], ["lang", "words", "bytes"])

    marks: dict[str, list] = defaultdict(list)
    for r in docs.sample(rate, seed=11).mapInArrow(run, "lang string, words array<binary>, bytes double").collect():  # MARKS rows a sampled document at most
        marks[r["lang"]].append((tuple(map(bytes, r["words"])), r["bytes"] / rate))
    step = max(range_bytes, sum(x for m in marks.values() for _, x in m) / max_ranges)
    out = {}
    for lang, mine in marks.items():
        mine.sort()
        out[lang], seen = [], 0.0
        for words, x in mine:
            seen += x
            if seen >= step:
                out[lang].append(words)
                seen = 0.0
        out[lang] = sorted(set(out[lang]))
    return out


def _place(table: list[bytes], keys: np.ndarray, words: tuple[bytes, ...]) -> int:
    """How many of the n-grams in order come before the one with these words."""
    lo, hi = 0, len(keys)
    for depth in range(3):
        if depth >= len(words):
            return lo  # the shorter one comes first, as no word is number 0
        at = bisect_right(table, words[depth])
        known = at > 0 and table[at - 1] == words[depth]
        column = keys[lo:hi, depth]
        first = lo + int(np.searchsorted(column, at if known else at + 1, "left"))
        if not known:
            return first
        lo, hi = first, lo + int(np.searchsorted(column, at, "right"))
    return lo


FORM = "lang string, r long, words long, body binary"


def pieces(docs: DataFrame, edges: dict[str, list[tuple[bytes, ...]]], shard_bytes: int = SHARD_BYTES, may: Broadcast | None = None, held_grams: int = HELD_GRAMS) -> DataFrame:
    """(lang, r, words, body): what tasks send. Shards of a language meet in their task until it holds `held_grams`; then what the largest language
    has is cut at the borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size, words = Counter(), Counter()

        def give(lang: str) -> Iterator[pa.RecordBatch]:
            table, keys, counts = united(held.pop(lang))
            n = words.pop(lang)  # a shard's words count once
            names = table.to_pylist() if edges.get(lang) else []
            cuts = [0, *(_place(names, keys, w) for w in edges.get(lang, [])), len(keys)]
            for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo or n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([r]), pa.array([n]), pa.array([Automaton.build(table, keys[lo:hi], counts[lo:hi]).dump()], pa.binary())], ["lang", "r", "words", "body"])
                    n = 0
            del size[lang], table, keys, counts, names
            give_back()

        for lang, raw, bounds in _by_lang(batches, shard_bytes):
            table, keys, counts, n = ngrams(raw, bounds, may and may.value, lang)
            if not n:
                continue
            held[lang].append((table, keys.astype(np.int32), counts))
            size[lang] += len(keys)
            words[lang] += n
            del table, keys, counts
            give_back()
            while size.total() >= held_grams:
                yield from give(max(held, key=size.__getitem__))
        for lang in list(held):
            yield from give(lang)

    return docs.mapInArrow(run, FORM)


def counted(docs: DataFrame, edges: dict[str, list[tuple[bytes, ...]]], least: int, shard_bytes: int = SHARD_BYTES, may: Broadcast | None = None, held_grams: int = HELD_GRAMS) -> DataFrame:
    """(lang, r, words, body): for each prefix range the automaton of its n-grams with counts of at least `least`."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = unite(pdf["body"].tolist(), least).dump()
        give_back()
        return pd.DataFrame({"lang": [key[0]], "r": [key[1]], "words": [int(pdf["words"].sum())], "body": [out]})

    return pieces(docs, edges, shard_bytes, may, held_grams).groupBy("lang", "r").applyInPandas(merge, FORM)


def _lists(table: pa.Array, keys: np.ndarray) -> pa.Array:
    """The n-grams as lists of strings."""
    real = keys > 0
    offsets = np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), table.cast(pa.large_string()).take(pa.array(keys[real] - 1)).cast(pa.string()))


def candidates(ranges: DataFrame) -> DataFrame:
    """(lang, words, a): n-grams of two and three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = Automaton.load(body)
                keys, counts = a.paths()
                some = keys[:, 1] > 0
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(some.sum()), pa.string()), _lists(a.words, keys[some]), pa.array(counts[some])], ["lang", "words", "a"])

    return ranges.select("lang", "body").mapInArrow(run, "lang string, words array<string>, a long")


def part_counts(ranges: DataFrame, edges: dict[str, list[tuple[bytes, ...]]]) -> DataFrame:
    """(lang, part, f): the counts of all parts of all candidates, from the ranges that own them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = Automaton.load(body)
                keys, _ = a.paths()
                two, three = keys[(keys[:, 1] > 0) & (keys[:, 2] == 0)], keys[keys[:, 2] > 0]
                zero = lambda x, *at: np.stack([x[:, i] if i is not None else np.zeros(len(x), np.int64) for i in at], 1)
                parts = np.concatenate([zero(two, 0, None, None), zero(two, 1, None, None), zero(three, 0, None, None), zero(three, 2, None, None), zero(three, 0, 1, None), zero(three, 1, 2, None)])
                if not len(parts):
                    continue
                parts, ones = total_counts(parts, None, len(a.words))
                names = a.words.to_pylist() if edges.get(lang) else []
                cuts = [0, *(_place(names, parts, w) for w in edges.get(lang, [])), len(parts)]
                for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if hi > lo:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([r]), pa.array([Automaton.build(a.words, parts[lo:hi], np.ones(hi - lo, np.int64)).dump()], pa.binary())], ["lang", "r", "asked"])

    def answer(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        wanted = unite(asked["asked"].tolist())
        parts, f = [], []
        for body in own["body"]:  # one, or none where nothing is frequent
            keys, counts = Automaton.load(body).compose(wanted)
            parts += [" ".join(x) for x in _lists(wanted.words, keys).to_pylist()]
            f += counts.tolist()
        return pd.DataFrame({"lang": pd.Series([key[0]] * len(parts), dtype=object), "part": pd.Series(parts, dtype=object), "f": pd.Series(f, dtype="int64")})

    wanted = ranges.select("lang", "body").mapInArrow(ask, "lang string, r long, asked binary")
    return ranges.select("lang", "r", "body").groupBy("lang", "r").cogroup(wanted.groupBy("lang", "r")).applyInPandas(answer, "lang string, part string, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, cover_percent: int = 50, top: int = 2000, sample_docs: int = SAMPLE_DOCS, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    found = likely(texts, lambda batches: ((lang, raw, *words_of(raw, bounds)) for lang, raw, bounds in _by_lang(batches, shard_bytes)), least)
    may = docs.sparkSession.sparkContext.broadcast(found) if found else None
    edges = borders(texts, sample_docs, range_bytes, may=may)
    ranges = settle(counted(texts, edges, least, shard_bytes, may))
    total = ranges.groupBy("lang").agg(F.sum("words").alias("n"))
    found = candidates(ranges).withColumn("phrase", F.array_join("words", " "))
    parts = settle(part_counts(ranges, edges))

    joined = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", F.size("words").alias("size"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase of two words goes if one of three that holds it is frequent enough; only the most frequent one matters
    longer = found.where(F.size("words") == 3).select("lang", F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True)))
    # ranks first within 64 parts of a language, then among the first of each
    best = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
