"""HTML extraction, collocations and the filter audit against brute force, and on odd inputs."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import collocations, counting_bloom, filter_audit, html_extract, queries
from quillspark.llm.count_automata import Automaton, total_counts, unite, words_table
from quillspark.llm.html_blocks import blocks
from quillspark.llm.html_layouts import page

LOW = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


# ---- collocations


def made(seed=1, n=120):
    rng = random.Random(seed)
    words = ["a", "ab", "B", "zoé", "É", "x-y", "o'r", "ß", "ein", "the"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.choice((3, 10))]) + rng.choice([" "] * 8 + ["\t", ", ", ". ", "\n", "?", " . "]) for _ in range(rng.choice((0, 1, 30, 90))))
        out.append((i, text, rng.choice(["en", "de", None]), "extra"))
    return [*out, (7, None, "en", "x"), (None, "the the the the", None, None), (7, "", "", None), *[(900 + i, "hot pair of words", "en", "x") for i in range(30)]]


def brute_collocations(rows, least=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("options", [{}, {"range_bytes": 300, "shard_bytes": 500, "sample_docs": 10_000}, {"top": 3, "shard_bytes": 2000, "range_bytes": 2000}])
def test_collocations(spark, options):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string").repartition(3)
    got = sorted(tuple(r[c] for c in COLS) for r in collocations.collocations(df, **options).collect())
    assert got == brute_collocations(rows, top=options.get("top", 2000)) and len(got) > 5


def test_collocations_of_nothing_and_of_one_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], schema)).count() == 0
    long = [(1, "alpha beta gamma. " * 130_000, "en", None)]  # over 2 MB, cut at separators
    got = sorted(tuple(r[c] for c in COLS) for r in collocations.collocations(spark.createDataFrame(long, schema + ", x string"), shard_bytes=1 << 19).collect())
    assert got == [("en", 1, "alpha beta gamma", 130_000, 130_000, 130_000, 390_000, 1_000_000)]


def test_automata():
    rng = random.Random(2)
    counts = collections.Counter(tuple(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(400))

    def built(some):
        table = words_table(pa.array(sorted({w.encode() for p in some for w in p}), pa.large_binary()))
        number = {w.as_py().decode(): i + 1 for i, w in enumerate(table)}
        keys = np.array([[*(number[w] for w in p), 0, 0][:3] for p in some]).reshape(-1, 3)
        keys, totals = total_counts(keys, np.array(list(some.values())), len(table), narrow=4)  # the way for large tables of words
        return Automaton.build(table, keys, totals)

    def listed(a, keys, n):
        names = [x.as_py().decode() for x in a.words]
        return {tuple(names[k - 1] for k in row if k): int(c) for row, c in zip(keys, n)}

    a = Automaton.load(built(counts).dump())
    assert listed(a, *a.paths()) == dict(counts)
    assert len(a.levels[2][0]) <= 25  # equal states are one
    parts = [collections.Counter({p: n for p, n in counts.items() if hash(p) % 3 == k}) for k in range(3)]
    whole = unite([built(p).dump() for p in parts if p] + [built(counts).dump()], least=2)
    assert listed(whole, *whole.paths()) == {p: 2 * n for p, n in counts.items()}
    asked = built({("a",): 1, ("b", "c"): 1, ("z", "a"): 1, ("e", "e", "e"): 1})
    assert listed(asked, *a.compose(asked)) == {p: counts[p] for p in (("a",), ("b", "c"), ("e", "e", "e")) if p in counts}
    assert len(unite([]).paths()[0]) == 0


# ---- filter audit


def audited(seed=3):
    rng = random.Random(seed)
    base = ["", "short", "UPPER CASE TEXT", "w " * 250, " ".join(f"u{i}" for i in range(220)), "tag # here " + " ".join(f"v{i}" for i in range(210)), "\t \n", "x" * 2_200_000]
    rows = [(i, rng.choice(base[:-1]), rng.choice(["a", "b", "", None]), "z", 1) for i in range(150)]
    rows += [(5, "short", "a", "z", 1), (5, "short", "a", "z", 1), (5, "other", "a", None, 1), (None, "short", "b", "z", 1), (None, None, None, None, None), (999, base[-1], "b", "z", 1), (998, base[-1], "b", "z", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (5, 1, 1)]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audited()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask string, n int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    con = duckdb.connect()
    documents, labels_ = docs.toPandas(), marks.toPandas()  # noqa: F841
    documents["doc_id"], labels_ = documents["doc_id"].astype("Int64"), labels_.astype("Int64")
    con.register("documents", documents)
    con.register("labels", labels_)
    con.execute("SELECT * FROM (" + queries.oracle_sql()["op13_filter_audit"] + ") LIMIT 0")
    cols = [d[0] for d in con.description]
    want = {tuple(r) for r in con.execute(queries.oracle_sql()["op13_filter_audit"]).fetchall()}
    assert {tuple(r[c] for c in cols) for r in got} == want and len(got) == 3 * 600
    for part, group in itertools.groupby(sorted(got, key=lambda r: r["part"]), key=lambda r: r["part"]):
        ends = {r["kept"] for r in group if r["step"] == 5}
        assert len(ends) == 1, part  # what stays does not hang on the order


def test_filter_audit_of_nothing(spark):
    docs, marks = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).count() == 0
    assert filter_audit.audit(spark.createDataFrame([(1, "x", "s")], docs.schema), marks).count() == 600


def test_counting_bloom_misses_no_repeat(spark):
    rng = random.Random(6)
    keys = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(900)]
    rows = [(i, k) for i, k in enumerate([*keys, *keys[:40], *[keys[50]] * 500])]
    df = spark.createDataFrame(rows, "i long, key binary").repartition(6)
    n = collections.Counter(k for _, k in rows)
    got = counting_bloom.flag_possible_repeats(df, "key", least_segments=3).collect()
    assert sorted(r["i"] for r in got) == sorted(i for i, _ in rows)
    assert all(r["again"] for r in got if n[bytes(r["key"])] > 1)
    assert sum(r["again"] for r in got if n[bytes(r["key"])] == 1) < 150


# ---- html


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(html_extract.labelled_pages(spark))


def texts(spark, model, pages):
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    return [r["text"] for r in html_extract.extract(df, model).orderBy("id").collect()]


def test_extraction_of_layouts_not_trained_on(spark, model):
    made = [page(random.Random(f"held-{i}")) for i in range(200)]
    got = texts(spark, model, [h for h, _ in made])
    right = sum(g == t for g, (_, t) in zip(got, made))
    tp = sum(sum((collections.Counter(g.split("\n")) & collections.Counter(t.split("\n"))).values()) for g, (_, t) in zip(got, made))
    assert right >= 185 and tp / sum(len(t.split("\n")) for _, t in made) > 0.98 and tp / sum(len(g.split("\n")) for g in got) > 0.98


def test_extraction_of_the_given_pages(spark, model):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = texts(spark, model, [r["html"] for r in rows])
    for r, text in zip(rows, got):
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(x for x in want if x), r["page_id"]


def test_odd_pages(spark, model):
    article = "<article><h1>One &amp; two</h1><p>Some   words,\n here &lt;b&gt; &#228;&eacute;&nbsp;end.<script>no()</script><p>More <b>bold<br>words</b> are here, as ever.</article>"
    odd = [None, "", "no markup at all", "<p", "<a href='x", "&", "<script>var a = '<p>';", "<!-- <p>x</p>", article, f"<html><head><title>t</title>{article}"]
    got = texts(spark, model, odd)
    assert got[0] == got[1] == got[3] == got[4] == got[6] == got[7] == ""
    assert got[8] == got[9] == "One & two\nSome words, here <b> äé end.\nMore bold words are here, as ever."
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty, model).count() == 0
    long = "<article>" + "<p>A sentence of some words, which is long enough to be text.</p>" * 40_000 + "</article>"  # over 2 MB
    assert texts(spark, model, [long])[0].count("\n") == 39_999


@pytest.mark.parametrize("part", ["<a", "<!--", "<div>", "<b>", "</i>", "<p>x", "&", "<li><div>", "<", "</scrip", '<a href="', "<div a='", "<table><tr><td>"])
def test_broken_markup_takes_no_longer_than_its_length(part):
    import time

    began = time.time()
    blocks("<script>" * (part == "</scrip") + part * (400_000 // len(part)))
    assert time.time() - began < 5


def test_viterbi_is_the_best_sequence():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(1, 8)
        scores, same = [rng.gauss(0, 2) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        steps = [[[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)]
        total = lambda y: sum(s for s, a in zip(scores, y) if a) + sum(steps[same[i]][y[i - 1]][y[i]] for i in range(1, n))  # noqa: E731, B023
        assert total(html_extract.viterbi(scores, same, steps)) == pytest.approx(max(total(y) for y in itertools.product((False, True), repeat=n)))
