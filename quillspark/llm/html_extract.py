"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

A page becomes a sequence of leaf blocks (`html_blocks`). Features of a block are the elements and names (class, id, role) around it, the
nearest of them apart, and its text: length, share of links, punctuation, capitals, digits, words of short blocks, its neighbours' lengths and
its place. Blocks are main or not; transitions weigh differently where two blocks stand in one container. Weights are
trained on labelled pages, (html, text) with the blocks of the main text as lines, by gradient ascent on the penalised likelihood in numpy.
`labelled_pages` writes such pages from a seed, in many layouts with and without telling element names; `fit` takes any others.

Training reads at most `most` labelled pages; extraction reads whole pages, each on its own, so a lost task is only run again.

Defined cases: null html is empty, and a page without main text gives ''; ids and urls are carried along, null or repeated; scripts, styles,
head, templates and controls of forms are never text; a line break inside a block is white space; input without </body> ends
all open elements; tables without rows give none; other columns are not looked at.
"""

from __future__ import annotations

import json
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back
from .html_blocks import Block, blocks
from .html_layouts import page

MOST_PAGES = 2000
LEAST_SEEN = 3
ROUNDS, RATE, PENALTY = 200, 0.3, 1e-3
SHORT_WORDS = 12
SECTIONS = ("article", "aside", "dialog", "footer", "form", "header", "main", "nav", "section")
SIZES = (1, 2, 4, 8, 16, 32, 64, 128)


def _size(n: int) -> int:
    return sum(n > s for s in SIZES)


def features(page_blocks: list[Block]) -> list[list[str]]:
    out, sizes = [], [_size(b.text.count(" ") + 1) for b in page_blocks]
    n = len(page_blocks)
    for i, (b, size) in enumerate(zip(page_blocks, sizes)):
        t = b.text
        share = min(b.linked / len(t), 1.0)
        link = "none" if not share else "all" if share > 0.9 else "half" if share > 0.4 else "some"
        f = ["bias", "tag:" + b.tag, f"size:{size}", "link:" + link, f"link:{link}:{size > 3}", *b.around]
        f += ["near:" + x for x in b.near]
        f.append("sections:" + "+".join(x for x in SECTIONS if "in:" + x in b.around))
        f.append(f"tag:{b.tag}:size:{size}")
        if t[-1] in ".!?…。\"'”»)":
            f.append("ends")
        if "," in t:
            f.append("comma")
        f.append(f"stops:{min(t.count('. ') + t.count('? ') + t.count('! '), 4)}")
        if t[0].isupper():
            f.append("capital")
        if sum(map(str.isdigit, t[:200])) * 5 > min(len(t), 200):
            f.append("digits")
        if size <= 3:
            f += ["sign:" + c for c in "©|»·@$€" if c in t]
        if size <= 3 or t.count(" ") < SHORT_WORDS:
            f += {"word:" + w.strip(".,:;!?()[]«»\"'").lower() for w in t.split(" ")[:SHORT_WORDS]}
        f.append(f"before:{sizes[i - 1] if i else 'none'}")
        f.append(f"after:{sizes[i + 1] if i + 1 < n else 'none'}")
        f.append("place:" + ("first" if i == 0 else "last" if i == n - 1 else str(4 * i // n)))
        out.append(f)
    return out


def labels(page_blocks: list[Block], text: str | None) -> list[bool]:
    """Which blocks are lines of the main text; each line is used once, in order where a line repeats."""
    left = Counter((text or "").split("\n"))
    out = []
    for b in page_blocks:
        out.append(left[b.text] > 0)
        left[b.text] -= out[-1]
    return out


def train(pages: list[tuple[list[list[str]], list[bool], list[int]]], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> dict:
    """Weights of (features, labels, containers) of pages: names for main blocks, and transitions by (same container, from, to)."""
    pages = [p for p in pages if p[0]]
    seen = Counter(f for p in pages for b in p[0] for f in set(b))
    names = sorted(f for f, n in seen.items() if n >= LEAST_SEEN)
    number = {f: k for k, f in enumerate(names)}
    if not pages or not names:
        return {"weights": {}, "steps": np.zeros((2, 2, 2)).tolist()}
    longest, count = max(len(p[0]) for p in pages), len(pages)
    y, real, same = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool), np.zeros((count, longest), np.int64)
    row, col = [], []
    for i, (feats, gold, inside) in enumerate(pages):
        y[i, : len(gold)], real[i, : len(gold)] = gold, True
        same[i, 1 : len(inside)] = np.equal(inside[1:], inside[:-1])
        for j, b in enumerate(feats):
            mine = [number[f] for f in set(b) if f in number]
            row += [i * longest + j] * len(mine)
            col += mine
    row, col = np.array(row), np.array(col)
    w, steps = np.zeros(len(names)), np.zeros((2, 2, 2))
    grown_w, grown_s = np.full(len(names), 1e-8), np.full((2, 2, 2), 1e-8)
    both = real[:, 1:]
    gold_steps = np.zeros((2, 2, 2))
    np.add.at(gold_steps, (same[:, 1:][both], y[:, :-1][both], y[:, 1:][both]), 1)
    lse = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
    for _ in range(rounds):
        score = np.zeros((count, longest, 2))
        score[:, :, 1] = np.bincount(row, w[col], count * longest).reshape(count, longest)
        score[~real] = 0
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            on = lse(ahead[:, t - 1, :, None] + steps[same[:, t]], 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], on, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = lse(steps[same[:, t + 1]] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], on, 0)
        whole = lse(ahead[:, -1], 1)
        p = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None])
        g = np.bincount(col, np.where(real, y - p, 0).reshape(-1)[row], len(names)) / count - penalty * w
        pair = ahead[:, :-1, :, None] + steps[same[:, 1:]] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, same[:, 1:][both], np.exp(pair[both]))
        g_steps = (gold_steps - expected) / count - penalty * steps
        grown_w += g * g
        grown_s += g_steps * g_steps
        w += rate * g / np.sqrt(grown_w)
        steps += rate * g_steps / np.sqrt(grown_s)
    return {"weights": dict(zip(names, w.tolist())), "steps": steps.tolist()}


def viterbi(scores: list[float], same: list[bool], steps: list) -> list[bool]:
    """The best sequence, where scores are those of main over not main."""
    if not scores:
        return []
    no, yes, came = 0.0, scores[0], []
    for s, x in zip(scores[1:], same[1:]):
        (a, b), (c, d) = steps[x]
        from_no, from_yes = yes + c > no + a, yes + d > no + b
        came.append((from_no, from_yes))
        no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
    at = yes > no
    out = [at]
    for from_no, from_yes in reversed(came):
        at = from_yes if at else from_no
        out.append(at)
    return out[::-1]


def main_blocks(html: str | None, model: dict, known: frozenset[str]) -> list[str]:
    found = blocks(html, known)
    weight = model["weights"]
    scores = [sum(weight.get(f, 0.0) for f in set(b)) for b in features(found)]
    same = [i > 0 and found[i].inside == found[i - 1].inside for i in range(len(found))]
    return [b.text for b, use in zip(found, viterbi(scores, same, model["steps"])) if use]


def known_names(model: dict) -> frozenset[str]:
    """Names around a block that the model has a weight for, and elements that make sections."""
    return frozenset(n.removeprefix("near:") for n in model["weights"] if n.startswith(("in:", "name:", "near:"))) | {"in:" + x for x in SECTIONS}


def labelled_pages(spark: SparkSession, n: int = 1000, seed: int = 3) -> DataFrame:
    """(page, html, text): n pages in random layouts with their main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [page(random.Random(f"{seed}-{i}")) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], ["page", "html", "text"])

    return spark.range(0, n, 1, 4).mapInArrow(run, "page long, html string, text string")


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most: int = MOST_PAGES, seed: int = 3) -> dict:
    """Model from labelled pages, at most about `most` of them, drawn by hash; trained in one task."""
    rows = labelled.select(F.col(html_col).cast("string").alias("html"), F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("html", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < most / max(total, 1)) if total > most else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = pd.concat([pd.DataFrame({"html": [], "text": []}, dtype=object), *(b.to_pandas() for b in batches)])
        pages = []
        for html, text in sorted(zip(pdf["html"], pdf["text"]), key=lambda r: (r[0] or "", r[1] or "")):
            found = blocks(html)
            pages.append((features(found), labels(found, text), [b.inside for b in found]))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(train(pages))])], ["model"])

    return json.loads(sample.repartition(1).mapInArrow(run, "model string").first()["model"])


def extract(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of each page, its blocks as lines."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        known = known_names(model)
        for b in batches:
            texts = ["\n".join(main_blocks(h.as_py(), model, known)) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])
        give_back()

    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
