"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

A text is lower-cased (A-Z), everything in ASCII that is no letter becomes a word boundary, and the byte n-grams of 2 to 4
bytes inside words (boundaries included) are hashed to `BUCKETS` rows of an embedding table. The mean row times a linear
layer gives the logits. For prediction both layers fold into one table of logits per bucket. A temperature is fitted on a
part of the sample that the SGD never sees.

Rejection is calibrated on that part, too. The n-grams of the training part are kept as a bitmap of 2^20 bits; a text is familiar as far as
its n-grams are in it, which those of another script or of random letters are not. Floors for short, middling and long texts lie where the held-out
windows part best from the same windows with their letters drawn anew, but so that all but `REJECT_SHARE` of the windows pass. A text is rejected below its floor
of familiarity, below the score that all but `REJECT_SHARE` of the windows reach, or with under `LEAST_GRAMS` n-grams (one or two letters),
which say nothing.

Windows for training and calibration: of each text of the sample at most 6, at most 40 and at most 200 words at a random place.

Training reads a bounded sample, at most about `per_lang` labelled rows of each language; prediction reads whole texts.

Defined cases: null text, and text without a letter, is `und` with score 0 and is rejected; without any labelled row every
text is `und`; ids may be null or repeat; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sub_batches

BUCKETS, DIM = 1 << 16, 16
ORDERS = (2, 3, 4)
PER_LANG = 1500
REJECT_SHARE = 0.001
FEW_LANGS = 10_000
MARKS, LEAST_GRAMS, LENGTHS = 1 << 20, 8, (60, 400)
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one boundary before, after and between words, and their offsets."""
    docs = len(bounds) - 1
    size = np.diff(bounds)
    out = np.full(len(raw) + 2 * docs, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(2 * np.arange(docs) + 1, size)] = _FOLD[raw]
    edges = bounds + 2 * np.arange(docs + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[edges[:-1]] = True
    # a row's closing boundary goes when the text already ends in one; its opening one always stays
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[edges]


def grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket at each byte and its place in the bitmap; bucket 0 stands for no n-gram."""
    wide = text.astype(np.uint32)
    gap = text == 32
    n = len(text)
    for order in ORDERS:
        m = max(n - order + 1, 0)
        h = np.zeros(m, np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193) + wide[k : k + m] + np.uint32(order)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(16)) % np.uint32(BUCKETS - 1) + np.uint32(1)
        bad = gap[:m] & gap[1 : m + 1] if order == 2 else np.zeros(m, bool)
        for k in range(1, order - 1):
            bad |= gap[k : k + m]
        bucket[bad] = 0
        yield bucket, (h >> np.uint32(3)) % np.uint32(MARKS)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between each two bounds; bounds beyond the end are cut."""
    edges = np.minimum(bounds, len(values))
    out = np.zeros((len(bounds) - 1, values.shape[1]), np.float64)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, edges[some], axis=0)
        ends = edges[some + 1]
        tail = np.flatnonzero(np.append(edges[some][1:], len(values)) > ends)
        for t in tail:  # rows followed by an empty stretch: reduceat ran on to the next start
            out[some[t]] = values[edges[some[t]] : ends[t]].sum(0)
    return out


def _windows(texts: list[str], rng: np.random.Generator) -> list[list[bytes]]:
    """For each text a short, a middling and a long window of whole words."""
    out = []
    for t in texts:
        words = t.encode().split()
        mine = []
        for n in (6, 40, 200):
            n = int(rng.integers(max(1, n // 3), n + 1))
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            mine.append(b" ".join(words[at : at + n]))
        out.append(mine)
    return out


def train(texts: list[str], langs: list[str], seed: int, epochs: int = 3, rate: float = 0.3, batch: int = 32) -> dict:
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    y_doc = np.searchsorted(labels, langs)
    windows = _windows(texts, rng)
    held = rng.random(len(texts)) < 0.2
    if held.all() or not held.any():
        held[:] = False

    def both(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(chunk, np.uint8)
        text, _ = folded(raw, np.array([0, len(raw)]))
        got, mark = (np.concatenate(x) for x in zip(*grams(text)))
        return got[got > 0], mark[got > 0]

    def buckets(chunk: bytes) -> np.ndarray:
        return both(chunk)[0]

    met = np.zeros(MARKS, bool)
    for t, h in zip(texts, held):
        if not h:
            met[both(t.encode())[1]] = True

    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    pool = [(buckets(w), int(y)) for ws, y, h in zip(windows, y_doc, held) if not h for w in ws]
    pool = [x for x in pool if len(x[0])]
    steps = max(1, epochs * -(-len(pool) // batch))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(pool))
        for lo in range(0, len(order), batch):
            some = [pool[i] for i in order[lo : lo + batch]]
            idx = np.concatenate([x for x, _ in some])
            n = np.array([len(x) for x, _ in some])
            y = np.array([t for _, t in some])
            first = np.cumsum(n) - n
            mean = np.add.reduceat(table[idx], first, axis=0) / n[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            step = rate * (1 - done / steps)
            back = (p @ layer.T) * (step / len(y) * 20 / n[:, None])
            layer -= (step / len(y) * (mean.T @ p) * 20).astype(np.float32)
            bias -= (step / len(y) * p.sum(0)).astype(np.float32)
            # rows of the table that several n-grams share add up: sort once, sum runs
            by = np.argsort(idx, kind="stable")
            run = np.flatnonzero(np.r_[True, np.diff(idx[by]) > 0])
            table[idx[by][run]] -= np.add.reduceat(np.repeat(back, n, axis=0)[by], run, axis=0).astype(np.float32)
            done += 1
    logits = (table @ layer).astype(np.float32)
    logits[0] = 0
    # calibration on rows that the SGD has not seen, short windows and whole texts alike
    seen = [(w, int(y)) for ws, t, y, h in zip(windows, texts, y_doc, held) if h or not held.any() for w in (ws[0], ws[1], t.encode())]
    z, y = [], []
    for w, t in seen:
        b = buckets(w)
        if len(b):
            z.append(logits[b].mean(0) + bias)
            y.append(t)
    heat, floor = 1.0, 0.0
    if z:
        z, y = np.array(z, np.float64), np.array(y)

        def soft(t: float) -> np.ndarray:
            e = np.exp((z - z.max(1, keepdims=True)) / t)
            return e / e.sum(1, keepdims=True)

        grid = np.geomspace(0.05, 5, 40)
        heat = float(grid[np.argmin([-np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
        floor = float(np.quantile(soft(heat).max(1), REJECT_SHARE))
    # familiarity of held-out windows, and of the same windows with every letter drawn anew from those of the sample
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    near: list[list] = [[] for _ in range(len(LENGTHS) + 1)]
    far: list[list] = [[] for _ in range(len(LENGTHS) + 1)]
    for w, _ in seen:
        raw = np.frombuffer(w, np.uint8)
        noise = np.where(raw > 32, letters[rng.integers(0, 26, len(raw))], raw).tobytes()
        for chunk, into in ((w, near), (noise, far)):
            mark = both(chunk)[1]
            if len(mark) >= LEAST_GRAMS:
                into[int(np.searchsorted(LENGTHS, len(mark), "right"))].append(met[mark].mean())
    floors = []
    for a, b in zip(near, far):
        low = float(np.quantile(a, REJECT_SHARE)) if a else 0.0
        floors.append(min(low, (low + float(np.quantile(b, 0.99))) / 2) if b else low)
    return {"labels": labels, "logits": logits, "bias": bias, "heat": heat, "floor": floor, "met": np.packbits(met, bitorder="little"), "floors": floors}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, seed: int = 7) -> dict:
    """Model from a sample of about per_lang rows of each language, trained in one task; its size is BUCKETS x languages."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = F.broadcast(counts) if counts.count() <= FEW_LANGS else counts  # else texts would shuffle to meet a handful of rows
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(counts, "lang").where(draw < per_lang / F.col("n")).select("id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pd.concat([pd.DataFrame({"id": pd.Series([], dtype=object), "text": [], "lang": []}), *(b.to_pandas() for b in batches)])
        rows = rows[rows["text"].str.contains("[^\\W\\d_]", regex=True, na=False)] if len(rows) else rows
        if len(rows):
            rows = rows.sort_values(["id", "text", "lang"], na_position="first")
            m = train(rows["text"].tolist(), rows["lang"].tolist(), seed)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([m["labels"], m["heat"], m["floor"], m["bias"].tolist(), m["floors"]])]), pa.array([m["logits"].tobytes()], pa.binary()), pa.array([m["met"].tobytes()], pa.binary())], ["meta", "logits", "met"])

    got = sample.repartition(1).mapInArrow(run, "meta string, logits binary, met binary").collect()
    if not got:
        return {"labels": [], "heat": 1.0, "floor": 0.0, "bias": np.zeros(0, np.float32), "logits": np.zeros((BUCKETS, 0), np.float32), "met": np.zeros(MARKS // 8, np.uint8), "floors": [0.0] * (len(LENGTHS) + 1)}
    labels, heat, floor, bias, floors = json.loads(got[0]["meta"])
    return {"floors": floors, "met": np.frombuffer(bytes(got[0]["met"]), np.uint8), "labels": labels, "heat": heat, "floor": floor, "bias": np.array(bias, np.float32), "logits": np.frombuffer(bytes(got[0]["logits"]), np.float32).reshape(BUCKETS, len(labels))}


def score_batch(model: dict, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best label number and its calibrated probability for each row, and whether the row is strange or too short to tell."""
    text, edges = folded(raw, bounds)
    langs = len(model["labels"])
    table = np.concatenate([model["logits"], np.ones((BUCKETS, 1), np.float32)], 1)
    table[0] = 0
    met = np.unpackbits(model["met"], bitorder="little").astype(np.float32)
    total, familiar = np.zeros((len(bounds) - 1, langs + 1)), np.zeros(len(bounds) - 1)
    for bucket, mark in grams(text):
        total += row_sums(table[bucket], edges)
        familiar += row_sums((met[mark] * (bucket > 0))[:, None], edges)[:, 0]
    n = total[:, langs]
    z = (total[:, :langs] / np.maximum(n[:, None], 1) + model["bias"]) / model["heat"]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    floors = np.array(model["floors"])[np.searchsorted(LENGTHS, n, "right")]
    return p.argmax(1), p.max(1), (n < LEAST_GRAMS) | (familiar < floors * n)


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected appended, in place of columns of docs that have these names."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes) + ", lang_pred string, lang_score double, lang_rejected boolean"
    held = docs.sparkSession.sparkContext.broadcast(model)
    labels = model["labels"]
    most = max(1 << 16, (1 << 23) // (len(labels) + 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for rows, raw, bounds in sub_batches(batches, text, most):
            letters = pc.fill_null(pc.match_substring_regex(rows.column(rows.schema.get_field_index(text)), r"\pL"), False).to_numpy(zero_copy_only=False)
            n = rows.num_rows
            best, score, odd = score_batch(m, raw, bounds) if m["labels"] else (np.zeros(n, int), np.zeros(n), np.ones(n, bool))
            known = letters & bool(m["labels"])
            pred = [m["labels"][b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(~known | odd | (score < m["floor"]))], [*names, "lang_pred", "lang_score", "lang_rejected"])

    made = ["lang_pred", "lang_score", "lang_rejected"]
    return plain.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns) if c not in made], *made)
