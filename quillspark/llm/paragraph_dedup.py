"""Near-duplicate paragraphs by MinHash banding, and repeated passages inside long ones.

Paragraphs are the lines of a text. Each is a set of hashed word shingles; equal sets are one class, so a common line costs one row. Larger
sets get a MinHash signature, cut into bands that are tuned for the wanted recall; classes that collide in a band are
joined, exact Jaccard decides, and the components of the confirmed links are the groups.

A line of more than `LONG` words is also cut into pieces, so that a passage inside it is found though the rest of the line differs. A cut
stands before a word if a hash of it and its predecessor is the smallest within `REACH` words to both sides: it depends on
these words alone, so a passage of 50 words nearly always holds a whole piece. Pieces are grouped by equality of their words; those that no other
document has are not in the result.

A line or piece is repeated if two documents have its group, however short it is; of each group the first one stays, by document id and
place. `passage` says beside that whether the repeated lines, or the repeated pieces of a line, that follow each other have `passage_words` or more
together; repeats that have not (a license line, a greeting) are boilerplate. That is a report and decides nothing.

A passage inside a line goes with the pieces that lie in it, so up to `2 * REACH` words may stay at each of its ends.

Sets so small that no other set can be similar enough are compared by equality alone.

Defined cases: null and empty texts have no paragraphs; lines without words are no paragraphs; a line shorter than a shingle is one
shingle; a null document id sorts last in its group and counts as a document; rows that repeat an id repeat its paragraphs, of which one
stays, and count as one document; a text of any length is cut whole, in one task; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from .common import _DOWN, lowered, mix, powers, settle, shingle_sets, sub_batches, word_hashes, word_spans
from .linking import BROADCAST_IDS, NARROW, linked

HASHES, COMMON, RECALL = 14, 64, 0.999
LONG, REACH, PASSAGE_WORDS = 50, 6, 25


def tune_bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows to a band as the recall at this similarity allows with so many hashes."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Smallest value of each set under each hash; sets are not empty."""
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    salts = mix(np.arange(1, hashes + 1, dtype=np.uint64))
    return np.stack([np.minimum.reduceat(mix(flat ^ s), first) for s in salts], 1)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(pid, doc_id, place, words, n, print_a, print_b, keys, text): text and band keys only where a similar other set is possible."""
    least = -(-percent // (100 - percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "place", "words", "n", "print_a", "print_b", "keys", "text"]
        for b, raw, bounds in sub_batches(batches, "text"):
            cuts = np.union1d(np.flatnonzero(raw == 10) + 1, bounds)
            if len(cuts) < 2:
                continue
            sets = shingle_sets(lowered(raw), cuts, words)
            size = np.array([len(x) for x in sets])
            owner = np.searchsorted(bounds, cuts[:-1], "right") - 1
            use = np.flatnonzero(size)
            if not len(use):
                continue
            held = np.diff(word_spans(raw, cuts)[2])
            place = np.arange(len(cuts) - 1) - np.searchsorted(cuts, bounds[:-1])[owner]
            rich = size[use] >= least
            keys: list = [None] * len(use)
            if rich.any():
                sig = signatures([sets[k] for k in use[rich]], bands * rows)
                band = np.arange(bands, dtype=np.uint64)
                joined = np.zeros((len(sig), bands), np.uint64) + band
                for r in range(rows):
                    joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                for k, v in zip(np.flatnonzero(rich).tolist(), joined.view(np.int64).tolist()):
                    keys[k] = v
            data = raw.tobytes()
            text = [data[cuts[k] : cuts[k + 1]].decode("utf-8", "replace") if x else None for k, x in zip(use.tolist(), keys)]
            cols = [
                b.column(0).take(pa.array(owner[use])),
                pa.array(place[use]),
                pa.array(held[use].astype(np.int64)),
                pa.array(size[use]),
                pa.array(np.array([sets[k].sum(dtype=np.uint64) for k in use]).view(np.int64)),
                pa.array(np.array([mix(sets[k] + np.uint64(1)).sum(dtype=np.uint64) for k in use]).view(np.int64)),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(text, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = rows_in.mapInArrow(run, "doc_id long, place long, words long, n long, print_a long, print_b long, keys array<long>, text string")
    return cut.withColumn("pid", F.monotonically_increasing_id())


def piece_starts(hashes: np.ndarray, first: np.ndarray, long: int, reach: int) -> np.ndarray:
    """Numbers of the words before which long lines are cut, their first words included. first: number of each line's first word, and the end."""
    size = np.diff(first)
    wide = np.flatnonzero(size > long)
    if not len(wide):
        return np.zeros(0, np.int64)
    pair = mix(hashes * np.uint64(3) + np.concatenate(([np.uint64(0)], hashes[:-1])))
    best = np.full(len(pair), np.iinfo(np.uint64).max, np.uint64)
    for k in range(1, reach + 1):
        np.minimum(best[k:], pair[:-k], out=best[k:])
        np.minimum(best[:-k], pair[k:], out=best[:-k])
    cut = pair < best
    # the ends of a line count as cuts, so none stands within reach of them
    at = np.arange(len(pair)) - np.repeat(first[:-1], size)
    cut &= (at > reach) & (at < np.repeat(size, size) - reach) & np.repeat(size > long, size)
    cut[first[:-1][wide]] = True
    return np.flatnonzero(cut)


def pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, place, piece, start, end, words, name_a, name_b) of the pieces of long lines; start and end in characters of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, bounds in sub_batches(batches, "text"):
            cuts = np.union1d(np.flatnonzero(raw == 10) + 1, bounds)
            if len(cuts) < 2:
                continue
            low = lowered(raw)
            starts, ends, first = word_spans(low, cuts)
            hashes = word_hashes(low, starts, ends)
            at = piece_starts(hashes, first, LONG, REACH)
            if not len(at):
                continue
            line = np.searchsorted(first, at, "right") - 1
            # a piece ends where the next one starts, or its line ends
            stop = np.minimum(np.append(at[1:], len(hashes)), first[line + 1])
            names = []
            for salt in (0, 1):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)) * powers(len(hashes)))))
                names.append(mix((sums[stop] - sums[at]) * powers(len(hashes), _DOWN[1])[at] + (stop - at).astype(np.uint64)))
            owner = np.searchsorted(bounds, cuts[line], "right") - 1
            new = np.r_[True, line[1:] != line[:-1]]
            # characters before each byte: bytes that continue one do not count
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            left, right = starts[at], np.where(stop < first[line + 1], starts[np.minimum(stop, len(starts) - 1)], ends[stop - 1])
            cols = [
                b.column(0).take(pa.array(owner)),
                pa.array(line - np.searchsorted(cuts, bounds[:-1])[owner]),
                pa.array(np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]),
                pa.array(chars[left] - chars[cuts[line]]),
                pa.array(chars[right] - chars[cuts[line]]),
                pa.array((stop - at).astype(np.int64)),
                pa.array(names[0].view(np.int64)),
                pa.array(names[1].view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "place", "piece", "start", "end", "words", "name_a", "name_b"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, place long, piece long, start long, end long, words long, name_a long, name_b long")


def _passages(found: DataFrame, line: list[str], place: str, passage_words: int) -> DataFrame:
    """found (.., documents) with `passage`: whether the repeated neighbours of a row, in order of place within line, have enough words together."""
    some = found.where("documents > 1")
    each = W.partitionBy(*line).orderBy(place)
    # rows that repeat an id repeat its places, too
    step = F.col(place) - F.coalesce(F.lag(place).over(each), F.lit(-2))
    run = some.withColumn("step", (step > 1).cast("long")).withColumn("run", F.sum("step").over(each)).withColumn("together", F.sum("words").over(W.partitionBy(*line, "run")))
    return run.withColumn("passage", F.col("together") >= passage_words).drop("step", "run", "together").unionByName(found.where("documents <= 1").withColumn("passage", F.lit(False)))


def _grouped(placed: DataFrame, by: list[str]) -> DataFrame:
    """placed with its group's first paragraph and number of distinct documents."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "piece", "pid")
    each = placed.groupBy(*by, "doc_id").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    groups = each.groupBy(*by).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("documents"), F.sum("rows").alias("rows")).where("rows > 1")
    return placed.join(groups.drop("rows"), by, "left").withColumns({"documents": F.coalesce("documents", F.lit(1)).cast("long"), "best": F.coalesce("best", order)})


def paragraph_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, hashes: int = HASHES, recall: float = RECALL, common: int = COMMON, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row for each line, and for each piece of a long line that other documents have too.

    doc_id, place (of the line, from 0), piece (null for whole lines), start, end (characters of a piece in its line, null for whole lines), words, n (set
    size; of a piece its shingles), first_doc, first_place, first_piece (the first of the group), repeated (several documents have it), members (how
    many), passage (part of so many repeated words in a row), boilerplate (repeated and no passage), kept (false for all but the first of
    a repeated group).
    """
    bands, rows = tune_bands(percent / 100, recall, hashes)
    cut = settle(paragraphs(docs, id_col, text_col, words, percent, bands, rows))
    scale = cut.count()
    prints = ["print_a", "print_b", "n"]
    classes = cut.groupBy(*prints).agg(F.min("pid").alias("rep"))
    known = settle(cut.select("pid", "doc_id", "place", "words", *prints).join(classes, prints).select("pid", "doc_id", "place", "words", "n", "rep"), 1 + scale // NARROW)
    reps = known.where("pid = rep").select("pid")
    rich = cut.where(F.col("keys").isNotNull())
    listed = rich.join(reps, "pid", "left_semi").select(F.col("pid").alias("id"), "n", F.lit(0).alias("centre"), "keys")
    # keys that one class alone holds make no list
    flat = listed.select("id", F.explode("keys").alias("key"))
    met = flat.join(flat.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "key").groupBy("id").agg(F.collect_list("key").alias("values"), F.sum("held").alias("weight"))
    listed = settle(listed.join(met, "id").select("id", "n", F.col("weight").alias("centre"), "values"), 1 + scale // NARROW)
    found = linked(listed, rich.select(F.col("pid").alias("id"), "text"), words, percent, common, 1, scale, dense=False)
    none = F.lit(None).cast("long")
    placed = settle(known.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("pid", "doc_id", "place", none.alias("piece"), none.alias("start"), none.alias("end"), "words", "n", F.coalesce("component", "rep").alias("component")), 1 + scale // NARROW)
    lines = _passages(_grouped(placed, ["component"]), ["doc_id"], "place", passage_words)

    # names that several documents have; few enough of them spare the pieces a shuffle, else they meet by it
    parts = pieces(docs, id_col, text_col).withColumn("pid", F.monotonically_increasing_id())
    more = settle(parts.groupBy("name_a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("none")).where("lo < hi OR none").select("name_a"), 1 + scale // NARROW)
    shared = settle(parts.join(F.broadcast(more) if more.count() <= BROADCAST_IDS else more, "name_a"), 1 + scale // NARROW)
    n = F.greatest(F.col("words") - (words - 1), F.lit(1))
    inner = _passages(_grouped(shared, ["name_a", "name_b"]), ["doc_id", "place"], "piece", passage_words // 2).where("documents > 1").withColumn("n", n)
    again = F.col("documents") > 1
    columns = ["doc_id", "place", "piece", "start", "end", "words", "n", F.col("best.doc_id").alias("first_doc"), F.col("best.place").alias("first_place"), F.col("best.piece").alias("first_piece"), again.alias("repeated")]
    columns += [F.col("documents").alias("members"), "passage", (again & ~F.col("passage")).alias("boilerplate"), (~again | (F.col("pid") == F.col("best.pid"))).alias("kept")]
    return lines.select(*columns).unionByName(inner.select(*columns))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without what does not stay: lines go as a whole, pieces of lines by their characters. Ids must be unique here; a row without an id stays
    whole."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    gone = paragraph_groups(docs, id_col, text_col, **options).where("NOT kept AND doc_id IS NOT NULL")
    gone = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.when(F.col("piece").isNull(), F.col("place"))).alias("_lines"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "start", "end")))).alias("_spans"))
    joined = docs.toDF(*names).join(gone, F.col(key).cast("long") == F.col("_doc"), "left")

    def cut(line, i):  # noqa: ANN001, ANN202
        """What is left of a line; null if it goes."""
        own = F.filter("_spans", lambda s: s["place"] == i)
        state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        step = lambda a, s: F.struct(F.concat(a["out"], F.substring(line, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at"))
        rest = lambda a: F.rtrim(F.concat(a["out"], F.substring(line, a["at"].cast("int") + 1, F.length(line))))
        return F.when(F.array_contains("_lines", i.cast("long")), None).when(F.size(own) == 0, line).otherwise(F.aggregate(own, state, step, rest))

    kept = F.array_compact(F.transform(F.split(F.col(text), "\n"), cut))
    return joined.withColumn(text, F.when(F.col("_doc").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*names).toDF(*docs.columns)
