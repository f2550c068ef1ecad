"""Rare n-grams go before automata are built, and a task's shards meet before they are sent."""

import collections
import random

import numpy as np
import pytest

from quillspark.llm import collocations, likely_grams
from quillspark.llm.common import word_hashes
from quillspark.llm.count_automata import Automaton

LEAST = 10


def rows_of(seed=5, n=300):
    rng = random.Random(seed)
    head = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rng.choice(head) if rng.random() < 0.7 else f"rare{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))
    return [(i, rng.choice([text(), text() + ", " + text(), "", " \t "]), rng.choice(["aa", "bb"])) for i in range(n)]


def counts_of(rows):
    out = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for piece in text.split(","):
            w = piece.split()
            for k in (1, 2, 3):
                out[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return out


def shards(batches):
    return ((lang, raw, *collocations.words_of(raw, bounds)) for lang, raw, bounds in collocations._by_lang(batches, 2000))


def listed(body):
    a = Automaton.load(bytes(body))
    keys, counts = a.paths()
    return {tuple(a.words[int(k) - 1].as_py().decode() for k in key if k): int(c) for key, c in zip(keys, counts)}


@pytest.mark.parametrize(("segment_bytes", "held"), [(1 << 20, 6 << 20), (3000, 500)])
def test_marks_lose_no_frequent_gram(spark, monkeypatch, segment_bytes, held):
    monkeypatch.setattr(likely_grams, "HELD_HASHES", held)
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang").repartition(3)
    may = likely_grams.likely(docs, shards, LEAST, segment_bytes)
    assert may.segments == -(-sum(len(t) for _, t, _ in rows) // segment_bytes)
    ruled_out = rare = 0
    for lang, own in counts_of(rows).items():
        for gram, n in own.items():
            raw = np.frombuffer(" ".join(gram).encode(), np.uint8)
            starts, ends, _ = collocations.words_of(raw, np.array([0, len(raw)]))
            held_by = bool(may.holds(likely_grams.gram_hashes(word_hashes(raw, starts, ends), lang)[len(gram) - 1])[0])
            assert held_by or n < LEAST
            rare += n < LEAST
            ruled_out += not held_by
    assert rare > 3000 and ruled_out > 0.9 * rare
    assert likely_grams.likely(docs, shards, 1) is None


def test_full_marks_cost_work_alone(spark, monkeypatch):
    monkeypatch.setattr(likely_grams, "BITS", 8)
    monkeypatch.setattr(likely_grams, "BLOCK_BITS", 8)
    rows = rows_of(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["phrase"]): (r["a"], r["n"]) for r in collocations.collocations(docs, cover_percent=1000).collect()}
    want = counts_of(rows)
    assert got == {(lang, " ".join(p)): (a, sum(c for q, c in own.items() if len(q) == 1)) for lang, own in want.items() for p, a in own.items() if len(p) > 1 and a >= LEAST}


def test_shards_of_a_task_meet_before_they_are_sent(spark):
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang").coalesce(1)
    edges = {"aa": [(b"w3",), (b"w5", b"w2")], "bb": []}
    sent = collocations.pieces(docs, edges, shard_bytes=500).collect()
    assert sorted((r["lang"], r["r"]) for r in sent) == [("aa", 0), ("aa", 1), ("aa", 2), ("bb", 0)]  # before: one for each of the shards too
    want = counts_of(rows)
    total = {lang: sum(c for p, c in own.items() if len(p) == 1) for lang, own in want.items()}
    for some in (sent, collocations.pieces(docs, edges, shard_bytes=500, held_grams=50).collect()):
        seen, words = collections.defaultdict(collections.Counter), collections.Counter()
        for r in some:
            seen[r["lang"]].update(listed(r["body"]))
            words[r["lang"]] += r["words"]
        assert seen == want and words == total


def test_words_count_where_no_gram_is_left(spark):
    docs = spark.createDataFrame([("a b c", "aa")], "text string, lang string")
    may = spark.sparkContext.broadcast(likely_grams.Likely(1, 8, np.zeros(1, np.uint8)))
    got = collocations.counted(docs, {}, LEAST, may=may).collect()
    assert [(r["lang"], r["r"], r["words"], listed(r["body"])) for r in got] == [("aa", 0, 3, {})]
