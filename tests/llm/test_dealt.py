"""The operators against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, license_scan, minhash_dedup, mixing, packing, paragraph_dedup, preferences, queries, substring_dedup, topk_search
from quillspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sketch string, digest int"


def texts(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "re", "ing", "über", "ñ", "É"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 40, 120]))) for _ in range(n)]
    shared = " ".join(word() for _ in range(60))
    out = [*base, base[3], base[4].upper(), "", None, " \n", "x" * 5000, shared + "\n" + base[0], base[1] + "\n" + shared]
    for t in base[:20]:
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if i % 5 else 1, "s", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "same words here again now", None, None, None, None, None)] * 3 + [(None, "no id at all", "en", None, 1, None, 2), (2, None, None, "a", None, None, None), (3, "", "en", "a", 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(links).collect()} == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_near_groups(docs):
    sets = {i: shingles(t, 3) for i, t in enumerate(texts())}
    want = brute_groups(sets, 85)
    got = minhash_dedup.near_groups(docs, words=3, percent=85).collect()
    assert {r["id"]: r["component"] for r in got} == want and {r["id"]: r["n"] for r in got} == {k: len(s) for k, s in sets.items()}


def test_near_groups_long_lists(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):  # copies of a base that is not the first of them, each with its own changes
        w = list(base)
        for k in rng.sample(range(120), 0 if i == 50 else rng.randint(1, 4)):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups({i: shingles(t, 3) for i, t in rows}, 85)
    assert {r["id"]: r["component"] for r in minhash_dedup.near_groups(df, words=3, percent=85, common=8).collect()} == want


def test_keep_one(docs, empty, odd):
    assert minhash_dedup.keep_one(empty).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash_dedup.keep_one(odd).collect()) == ["1", "1", "1", "2", "3", "None"]
    assert minhash_dedup.keep_one(docs).columns == docs.columns


def test_exact_groups(docs, empty, odd):
    low = {i: (t or "").translate(LOW) for i, t in enumerate(texts())}
    best = {}
    for i, t in low.items():
        best[t] = max(i, best.get(t, -1))
    n = collections.Counter(low.values())
    got = exact_dedup.exact_groups(docs).collect()
    assert {(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got} == {(i, best[t], n[t], best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in low.items()}
    small = exact_dedup.exact_groups(docs, filter_bytes=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert exact_dedup.exact_groups(empty).count() == 0
    assert collections.Counter((r["id"], r["kept"]) for r in exact_dedup.exact_groups(odd).collect()) == {(1, True): 1, (1, False): 2, (None, True): 1, (2, False): 1, (3, True): 1}


def test_drop_exact_copies(docs, empty, odd):
    assert {r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()} == {r["id"] for r in exact_dedup.exact_groups(docs).where("kept").collect()}
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert collections.Counter(r["doc_id"] for r in exact_dedup.drop_exact_copies(odd).collect()) == {1: 1, None: 1, 3: 1}


def test_paragraph_groups(docs, empty, odd):
    sets = {(i, k): shingles(line, 5) for i, t in enumerate(texts()) for k, line in enumerate((t or "").split("\n")) if WORD.search(line)}
    want = brute_groups(sets, 80)
    got = paragraph_dedup.paragraph_groups(docs).collect()
    lines = [r for r in got if r["piece"] is None]
    assert {(r["doc_id"], r["place"]): (r["first_doc"], r["first_place"]) for r in lines} == want
    held = collections.defaultdict(set)
    for k, v in want.items():
        held[v].add(k[0])
    assert {(r["doc_id"], r["place"]): (r["members"], r["kept"]) for r in lines} == {k: (len(held[v]), k == v or len(held[v]) == 1) for k, v in want.items()}
    assert paragraph_dedup.paragraph_groups(empty).count() == 0
    assert [r["kept"] for r in paragraph_dedup.paragraph_groups(odd).collect()] == [True] * 4  # one document's own lines, too short besides
    assert paragraph_dedup.tune_bands(0.8, 0.9999, 20) == (10, 2) and paragraph_dedup.tune_bands(0.8, 0.9999, 6) == (6, 1)


def test_passages(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(n))
    passage, license_line, spread = words(54), words(14), [words(9) for _ in range(6)]
    rows = [(i, f"{license_line}\n{words(40)} {passage} {words(30)}") for i in range(6)]
    rows += [(i, f"{license_line}\n{words(150)}\n{words(8)}") for i in range(6, 30)]
    rows += [(i, "\n".join([words(12), *spread, words(12)])) for i in range(30, 33)]
    rows += [(40, words(400_000)), (41, None), (None, passage)]
    got = paragraph_dedup.paragraph_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["passage"]} == {*range(6), *range(30, 33), None}
    assert {r["doc_id"] for r in got if r["repeated"]} == {*range(33), None}
    first = [r for r in got if r["place"] == 0 and r["piece"] is None and r["doc_id"] is not None and r["doc_id"] < 30]
    assert {(r["members"], r["boilerplate"], r["kept"]) for r in first} == {(30, True, True), (30, True, False)} and sum(r["kept"] for r in first) == 1
    whole = [r for r in got if r["doc_id"] in range(30, 33) and r["passage"]]
    assert {(r["place"], r["members"], r["kept"]) for r in whole} == {(k, 3, f) for k in range(1, 7) for f in (True, False)}
    # only pieces that several documents have are rows
    assert all(r["members"] > 1 for r in got if r["piece"] is not None)


@pytest.mark.parametrize("size", [1, 5, 20, 60])
def test_repeated_lines_stay_once_whatever_their_length(spark, size):
    rng = random.Random(size)
    words = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n))
    shared = words(size)
    rows = [(i, "\n".join(rng.sample([shared, words(30), words(7)], 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [r for r in paragraph_dedup.paragraph_groups(df).collect() if r["piece"] is None]
    want = brute_groups({(i, k): shingles(line, 5) for i, t in rows for k, line in enumerate(t.split("\n"))}, 80)
    held = collections.Counter(want.values())
    assert {(r["doc_id"], r["place"]): r["kept"] for r in lines} == {k: held[v] == 1 or k == v for k, v in want.items()}
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.drop_repeats(df).collect()}
    assert [i for i, t in left.items() if shared in t.split("\n")] == [0]
    assert all(set(left[i].split("\n")) == set(t.split("\n")) - ({shared} if i else set()) for i, t in rows)


def test_passages_inside_lines_are_cut_out(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"é{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n))
    passage = words(80)
    own = [(words(40), words(45)) for _ in range(5)]
    rows = [(i, f"{words(3)}\n{a} {passage} {b}\n{words(60)}", "kept") for i, (a, b) in enumerate(own)]
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, _spans string")).collect()}
    assert left[0] == rows[0][1]
    for i in range(1, 5):
        head, line, tail = left[i].split("\n")
        assert [head, tail] == [rows[i][1].split("\n")[k] for k in (0, 2)]
        assert line.startswith(own[i][0]) and line.endswith(own[i][1])
        assert len(set(line.split()) & set(passage.split())) <= 4 * paragraph_dedup.REACH


def test_drop_repeats(spark):
    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a b c\n{line}"), (2, f"{line}\nnew words only here"), (None, line), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in paragraph_dedup.drop_repeats(df).collect()} == {1: f"a b c\n{line}", 2: "new words only here", None: line, 3: None, 4: ""}


def test_repeats(docs, empty, odd):
    seen, want = {}, {}
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        want[i] = bytes(c for c, g in zip(b, gone) if not g)
    got = substring_dedup.repeats(docs).collect()
    assert {r["id"]: bytes(r["kept"]) for r in got} == want
    for r in got:
        assert r["n_bytes"] == len(r["kept"]) + sum(s["end"] - s["start"] for s in r["spans"])
    assert substring_dedup.repeats(empty).count() == 0
    assert substring_dedup.repeats(odd).count() == 6
    assert substring_dedup.repeats(odd.where("text = '' OR text IS NULL")).count() == 2


def test_packing_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in got:
        pieces[r["id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in enumerate(texts()):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(bytes(r["ids"]) for r in sorted(pieces[i], key=lambda r: r["start"])) == ids
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and len(rs) <= packing.MAX_SEGMENTS
    assert packing.pack(empty, path).count() == 0


def test_packing_limits_without_cutting(spark):
    import public_tokenizers

    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(1, 60)), rng.randint(0, 30)) for i in range(300)], "doc_id long, text string, loss int").coalesce(1)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), loss_col="loss", max_tokens=100, max_segments=4, max_loss=64, cut=False).collect()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r["start"] == 0 and r["length"] == r["doc_tokens"]
        for k, v in enumerate((r["length"], 1, r["loss_tokens"])):
            by[r["sequence_id"]][k] += v
    assert len(got) == 300 and all(a <= 100 and b <= 4 and c <= 64 for a, b, c in by.values())
    assert sum(x[0] for x in by.values()) / (100 * len(by)) > 0.6


@pytest.mark.parametrize("segments", [4096, 256])
def test_short_texts_are_packed_with_little_padding(spark, segments):
    import public_tokenizers

    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(1, 5))) for i in range(20_000)], "doc_id long, text string").coalesce(2)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), max_segments=segments).select("sequence_id", "length", "id", "doc_tokens").toPandas()
    by = got.groupby("sequence_id")["length"].agg(["sum", "size"])
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in by["sum"])
    assert by["size"].max() <= segments and by["sum"].max() <= 4096 and padded < 0.02 * got["length"].sum()
    assert (got.groupby("id")["length"].sum() == got.groupby("id")["doc_tokens"].first()).all()


def test_near_groups_of_repeated_ids(spark):
    a, b, c = "one two three four five six", "one two three four five six seven eight nine", "something quite different from the others here"
    rows = [(5, b), (5, a), (3, a), (9, c), (9, c), (7, None), (7, c), (None, a)]
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r["id"], r["n"], r["component"]) for r in got) == [(3, 4, 3), (5, 4, 3), (5, 4, 3), (7, 0, 7), (7, 0, 7), (9, 5, 9), (9, 5, 9)]


def test_strange_texts_are_of_no_known_language(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(20))
    odd = ["Мама мыла раму и пошла домой вечером", "日本語の文章はここにあります。今日は良い天気です", "Η γλώσσα αυτή δεν είναι γνωστή εδώ", noise, "xqzj vkwq zzkx", "a", "12 34", None]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "i int, text string, lang_rejected string")
    got = language_id.predict(rows, model)
    assert got.columns == ["i", "text", "lang_pred", "lang_score", "lang_rejected"] and all(r["lang_rejected"] for r in got.collect())
    assert language_id.predict(docs, model).where("lang_rejected").count() <= 5


def test_pipeline_stages_keep_any_column_names(spark, tmp_path):
    import corpus_pipeline

    extra = ["_row", "_times", "_copy", "lang_rejected", "lang_pred", "_c1", "tag", "again"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), *(f"{c}{i}" for c in extra)) for i, t in enumerate([*texts()[:40], "some words of a very long text \n" * 80_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns[5:] == extra, name
        for r in docs.collect():
            assert [r[c] for c in extra] == [f"{c}{r['doc_id']}" for c in extra], name
    assert docs.where("length(text) > 2000000").count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_top_k(spark, empty):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype("float32")
    v[100:220] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(400, None), (401, [1.0, None]), (500, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = np.floor(1024 * v.astype(float)).astype(int)
    got = topk_search.top_k(df, shard_rows=90).collect()
    for q in range(0, 400, 100):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, s[i]) for i in order]
    assert {r["query_id"] for r in got} == {0, 100, 200, 300}
    assert topk_search.top_k(df.limit(0)).count() == 0
    few = topk_search.top_k(spark.createDataFrame([(0, [1e12, 1.0]), (1, [2e12, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["id"], r["rank"], r["score"]) for r in few] == [(1, 1, 2**63 - 1)]


def test_top_k_large_scores_and_mixed_lengths(spark):
    """Equal scores beyond 2^53 in several shards, near ones that doubles cannot tell apart, lengths apart, repeated ids, another column."""
    rng = random.Random(8)
    big = [float(3 * 2**17), float(2**16 + 1)]
    rows = [(i, big) for i in range(60)] + [(100 + i, [big[0], big[1] + rng.choice([0, 0, -(2.0**-10)])]) for i in range(1, 60)]
    rows += [(i, [1.0, 2.0, float(i % 7)]) for i in range(200, 240)] + [(300, [1.0]), (7, big), (7, big)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, shard_rows=9, pivots=3).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q, v in whole:
        if q % 100 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert max(s for _, _, s in got[0]) > 2**53


def test_mix(docs, empty, odd):
    got, about = mixing.mix(docs)
    rows, sources = got.collect(), {r["source"]: r for r in about.collect()}
    assert len(rows) == len(texts()) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken, size = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r["members"][0]] += r["taken"]
        size[r["members"][0]] += r["size"]
    total = sum(size.values())
    assert sum(r["target"] for r in sources.values()) == pytest.approx(min(1.5, 2) * total)
    assert [sources[k]["weight"] for k in ("a", "b", None)] == [3, 1, 2]
    for k, r in sources.items():
        assert r["source_size"] == size[k] and r["target"] <= 2 * size[k] and taken[k] == pytest.approx(r["target"], rel=0.05)
    again, _ = mixing.mix(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert mixing.mix(empty)[0].count() == 0 and mixing.mix(odd)[0].count() == 6


def test_flow_uses_overlap_before_repeating():
    # pattern 0 in source 0, pattern 1 in both; source 1 can only be fed by pattern 1
    flows = mixing.route([10, 10], [[0], [0, 1]], [10, 10], 2)
    assert flows == [{0: 10}, {0: 0, 1: 10}]
    assert mixing.targets([10, 100], [1, 1], 60, 2) == [20.0, 40.0]


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x"] if i % 2 else ["x", "y"]) for i in range(200)]
    got, about = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 1), share=0.5)
    assert sum(r["taken"] for r in got.collect()) == pytest.approx(sum(r["routed"] for r in about.collect()), abs=20)


def test_language(spark, empty, odd):
    rng = random.Random(0)
    langs = {"aa": ["an", "the", "ing", "re"], "bb": ["öl", "über", "sch", "ich"], "cc": ["ção", "ñe", "que", "os"]}
    make = lambda k, n: " ".join("".join(rng.choice(langs[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(k, rng.randint(4, 60)), k) for i, k in enumerate(rng.choice(sorted(langs)) for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 4 <> 2"))
    got = language_id.predict(df.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["lang_score"] <= 1 for r in got)
    blank = language_id.predict(spark.createDataFrame([(1, None, "aa"), (2, "12 !?", "aa"), (3, "", "aa")], df.schema), model).collect()
    assert all(r["lang_pred"] == "und" and r["lang_score"] == 0 and r["lang_rejected"] for r in blank)
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_licenses(spark, empty, odd):
    filler = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, "/r/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (2, "/r/a/b/code", filler),
        (3, "/r/a/NOTICE", "Released under the MIT License."),
        (4, "/r/c/code", filler + "\nLicensed under the Apache License, Version 2.0.\n" + filler),
        (5, "/q/code", filler),
        (6, None, None),
    ]
    got = {r["id"]: (r["own_license"], r["license"], r["from_dir"]) for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("GPL-3.0", "GPL-3.0", None), 2: (None, "MIT", "/r/a"), 3: ("MIT", "MIT", None), 4: ("Apache-2.0", "Apache-2.0", None), 5: (None, None, None), 6: (None, None, None)}
    assert license_scan.scan(empty, "doc_id", "source", "text").count() == 0 and license_scan.scan(odd, "doc_id", "source", "text").count() == 6


def test_licence_texts_and_headers(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    gnu = "This {1} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {0} License\nas published by the Free Software Foundation; either version {2}\nof the License, or (at your option) any later version.\n\nThis {1} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {0} License for more details."
    code = lambda head: "import os\n" + "".join(f"# {x}".rstrip() + "\n" for x in head.split("\n")) + "\n\n\n" + "\n".join([filler] * 20)
    headers = [(f"SPDX-License-Identifier: {k}", k.removesuffix("-or-later")) for k in ("MIT", "Apache-2.0", "GPL-2.0-or-later", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0")]
    headers += [("This file is licensed under the MIT license.", "MIT"), ("SPDX-License-Identifier: Zlib", None), ("Licensed under CC BY 4.0.", "CC-BY-4.0")]
    headers += [(gnu.format(*x), k) for k, x in {"GPL-2.0": ("General Public", "program", "2"), "GPL-3.0": ("General Public", "program", "3"), "LGPL-2.1": ("Lesser General Public", "library", "2.1"), "LGPL-3.0": ("Lesser General Public", "library", "3"), "AGPL-3.0": ("Affero General Public", "program", "3")}.items()]
    headers.append(("Copyright 2020 Some One. All rights reserved.\n\n\n\n\n\n\n\nReleased under the\nMIT License.", "MIT"))
    texts_ = license_scan.licence_texts()
    headers += [(texts_[k].split("\n\n", 1)[1], k) for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    cut = lambda t: "Copyright (c) 2021 Jane Doe and others\n\n" + t[: int(len(t) * 0.9)]
    rows = [(i, f"/h{i}/x.py", code(h)) for i, (h, _) in enumerate(headers)]
    names = sorted(texts_)
    rows += [(1000 + i, f"/f{i}/LICENSE", cut(texts_[k])) for i, k in enumerate(names)] + [(2000 + i, f"/f{i}/src/x.py", filler) for i in range(len(names))]
    rows += [(3000 + i, None, filler) for i in range(200)]
    got = {r["id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {h: got[i]["own_license"] for i, (h, _) in enumerate(headers)} == dict(headers)
    assert not any(got[i]["is_license_file"] for i in range(len(headers)))
    assert {k: (got[1000 + i]["own_license"], got[1000 + i]["is_license_file"], got[2000 + i]["license"]) for i, k in enumerate(names)} == {k: (k, True, k) for k in names}


def test_license_scan_inherits_over_levels(spark, tmp_path):
    from quillspark.llm import queries

    filler = " ".join(f"word{i}" for i in range(40))
    notes = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, notes[i // 19 % 2] if i % 19 == 0 else filler, f"src{i % 20}") for i in range(2000)]
    spark.createDataFrame([*rows, (None, filler, None)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_license_scan(spark, str(tmp_path)).collect()
    folder = {r["doc_id"]: r["path"].rsplit("/", 1)[0] for r in got}
    best = {}
    for r in got:
        if r["is_license_file"]:
            d = folder[r["doc_id"]]
            best[d] = min(best.get(d, (1,)), (-r["own_score"], r["doc_id"], r["own_license"]))
    over = 0
    for r in got:
        up = folder[r["doc_id"]]
        want = (r["own_license"], None)
        levels = 0
        while want == (None, None) and up:
            want = (best[up][2], up) if up in best else want
            up, levels = up.rsplit("/", 1)[0], levels + 1
        assert (r["license"], r["from_dir"]) == want
        over += want[1] is not None and levels > 2
    assert len(got) == 2001 and over > 200 and len(set(folder.values())) < 700 and {p.count("/") for p in folder.values()} == {1, 2, 3, 4}


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "lost"), (0, 1, "assistant", "yes")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preferences.swapped_answers(table)
    got = {r["id"]: r for r in preferences.format_pairs(pairs).collect()}
    assert sorted(got) == [0, 1, 2]
    assert {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in preferences.conversations(table).collect()} == {r["id"]: [(t["role"], t["text"]) for t in r["chosen"]] for r in pairs.collect()}
    clash = preferences.format_pairs(pairs.selectExpr("*", "1 AS _cut", "2 AS prompt", "3 AS _chosen"))
    assert clash.columns == ["id", "_cut", "_chosen", *preferences.MADE] and {r["id"]: r["prompt"] for r in clash.collect()} == {k: r["prompt"] for k, r in got.items()}
    assert preferences.format_pairs(preferences.swapped_answers(table.limit(0))).count() == 0
    r = got[0]
    assert (r["prefix_turns"], r["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    span = r["chosen_spans"][0]
    assert r["chosen_text"][span["start"] : span["end"]] == "yes<|end|>\n" and "no<|end|>" in r["rejected_text"]
    assert got[2]["prefix_turns"] == 1 and got[2]["chosen_text"] == got[2]["rejected_text"] == "" and got[2]["chosen_spans"] == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].to_numpy().tolist()), key=repr)
    assert rows(got) == rows(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    low = [(i, (t or "").translate(LOW)) for i, t in enumerate(texts()) if re.search(r"[^\W\d_]", t or "")]
    last = {t: i for i, t in low}
    groups = brute_groups({i: shingles(t, 5) for t, i in last.items()}, 80)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {k for k, c in groups.items() if k == c}
    assert {r["doc_id"] for r in docs.collect()} == kept
    taken = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    times = collections.Counter(r["doc_id"] for r in taken.collect())
    assert max(times.values()) <= 2 and {r["doc_id"] for r in out} == set(times) <= kept
    ids = collections.Counter()
    for r in out:
        ids[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert all(ids[k] == times[k] * tokens[k] for k in times)


def test_mix_sources_keeps_rows_without_or_with_shared_ids(spark, tmp_path):
    import corpus_pipeline

    rows = [(None if i % 3 == 0 else i // 40, " ".join(["w"] * i), "en", ["a", "b", None][i % 7 % 3], i) for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["size"]: r["taken"] // r["size"] for r in mixing.mix(docs)[0].collect()}
    got = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert collections.Counter(r["n_chars"] for r in got.collect()) == collections.Counter({k: n for k, n in taken.items() if n})
    assert len(set(taken.values())) > 1
