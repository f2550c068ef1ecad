"""Threshold tuning against a plain search."""

import random

import numpy as np
import pytest

from quillspark.labels import LABELS, NEUTRAL
from quillspark.plans import training
from quillspark.sources import loaders


def table(rng, n):
    out = []
    for _ in range(n):
        gold = rng.choice(LABELS)
        w = {k: rng.random() + (1.2 if k == gold else 0) for k in LABELS}
        out.append((gold, {k: round(v / sum(w.values()), 3) for k, v in w.items()}))
    return out


def decide(p, t, margin):
    ok = sorted((-p[k], k) for k in LABELS if p[k] >= t[k])
    lead = max((p[k] for k in LABELS if k != NEUTRAL and p[k] >= t[k]), default=None)
    if not ok or (margin > 0 and lead is not None and lead - p[NEUTRAL] < margin):
        return NEUTRAL
    return ok[0][1]


def scores(rows, sane, t, margin):
    pairs = [(g, decide(p, t, margin)) for g, p in rows]
    f = []
    for k in LABELS:
        both = sum(g == k for g, _ in pairs) + sum(q == k for _, q in pairs)
        f.append(2 * sum(g == q == k for g, q in pairs) / both if both else 0.0)
    quiet, loud = ([decide(p, t, margin) == NEUTRAL for s, p in sane if s == kind] for kind in ("neutral_policy", "explicit_or_implicit_bias"))
    return sum(f) / 4, 1 - sum(quiet) / len(quiet), sum(loud) / len(loud)


def search(rows, sane, grid, margins, cap):
    fine = lambda x: x[1] <= cap + 1e-9 and x[2] <= cap + 1e-9
    best = None
    for m in margins:
        t = dict.fromkeys(LABELS, 0.5)
        for _ in range(10):
            for k in LABELS:
                top, keep = scores(rows, sane, t, m)[0], t
                for v in grid:
                    x = scores(rows, sane, {**t, k: v}, m)
                    if fine(x) and x[0] > top + 1e-8:
                        top, keep = x[0], {**t, k: v}
                t = keep
        x = scores(rows, sane, t, m)
        if fine(x) and (best is None or x[0] > best[2][0] + 1e-12):
            best = (t, m, x)
    return best


def frames(spark, rows, sane):
    ps = ", ".join(f"p_{k} double" for k in LABELS)
    return spark.createDataFrame([(g, *(p[k] for k in LABELS)) for g, p in rows], f"gold string, {ps}"), spark.createDataFrame([(s, "0", *(p[k] for k in LABELS)) for s, p in sane] + [("neutral_policy", "1", 1.0, 0.0, 0.0, 0.0)], f"slice_type string, ambiguous_stance string, {ps}")


@pytest.mark.parametrize("cap", [0.2, 0.35])
def test_tuning_equals_a_plain_search(spark, cap):
    rng = random.Random(4)
    rows = table(rng, 60)
    sane = [("neutral_policy" if g == NEUTRAL else "explicit_or_implicit_bias", p) for g, p in table(rng, 60)]
    grid, margins = (0.08, 0.2, 0.27, 0.3, 0.36, 0.41, 0.5, 0.85), (0.0, 0.04, 0.1)
    want = search(rows, sane, grid, margins, cap)
    got, about = training.tune_thresholds(*frames(spark, rows, sane), margins=margins, grid=grid, fpr_max=cap, fnr_max=cap, draws=300)
    assert scores(rows, sane, got, about["margin"]) == pytest.approx((about["f1_macro"], about["sanity_fpr"], about["sanity_fnr"]))
    assert want or cap < 0.35
    if want:
        assert (got, about["margin"]) == want[:2] and about["feasible"]


def test_caps_that_nothing_meets_are_reported(spark):
    p = dict.fromkeys(LABELS, 0.25)
    sane = [("neutral_policy", p), ("explicit_or_implicit_bias", p)]
    got, about = training.tune_thresholds(*frames(spark, [(NEUTRAL, p)], sane), draws=50)
    assert not about["feasible"] and max(about["sanity_fpr"], about["sanity_fnr"]) > 0.2 and set(got) == set(LABELS)
    assert len(training.GRID) == 85 and len(training.MARGINS) == 18 and (training.GRID[-1], training.MARGINS[-1]) == (0.92, 0.34) and np.isin(0.5, training.GRID)


def test_calibrate_and_tune_saves_what_it_returns(spark, tmp_path):
    rng = random.Random(6)
    rows, sane = table(rng, 80), [("neutral_policy" if g == NEUTRAL else "explicit_or_implicit_bias", p) for g, p in table(rng, 80)]
    path = str(tmp_path / "limits")
    slopes, intercepts, got, about = training.calibrate_and_tune(*frames(spark, rows, sane), path=path, margins=(0.0, 0.04), grid=(0.2, 0.3, 0.5), draws=50)
    saved = loaders.thresholds_table(spark.read.text(path)).collect()
    assert {r["label"]: r["threshold"] for r in saved} == got and {r["margin"] for r in saved} == {about["margin"]} and set(slopes) == set(intercepts) == set(LABELS)


def test_isotonic_probabilities_sum_to_one_and_keep_order(spark):
    rng = random.Random(7)
    df, _ = frames(spark, table(rng, 120), [("neutral_policy", dict.fromkeys(LABELS, 0.25))])
    models = training.fit_isotonic(df)
    got = training.apply_isotonic(df, models)
    assert got.columns == df.columns and all(abs(sum(r[f"p_{k}"] for k in LABELS) - 1) < 1e-9 for r in got.collect())
    for m in models.values():
        assert list(m.predictions) == sorted(m.predictions)


def test_report_is_of_unseen_rows_and_the_model_of_all(spark):
    rng = random.Random(8)
    rows = [(i, LABELS[i % 4], *(float(i % 4 == k) + rng.random() for k in range(4))) for i in range(80)]
    df = spark.createDataFrame(rows, "post_id long, label string, " + ", ".join(f"x{k} double" for k in range(4)))
    model, report = training.report_then_refit(df, ("x0", "x1", "x2", "x3"), "post_id")
    assert sum(r["support"] for r in report.collect()) == 16 and model == training.fit_fusion(df, ("x0", "x1", "x2", "x3"))


def test_no_word_goes_by_rank(spark):
    rng = random.Random(9)
    kinds = {"gender_bias": "women", "nationality_bias": "border", "profession_bias": "office", "neutral": "report"}
    rows = [(k, f"{w} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(5))}") for k, w in kinds.items() for _ in range(30)]
    df = spark.createDataFrame(rows, "label string, text string")
    model = training.text_pipeline(1 << 12).fit(df)
    words = sorted({w for _, t in rows for w in t.split()})
    got = {(r["label"], r["word"]): r["weight"] for r in training.word_weights(model, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert len(got) == 4 * len(words)
    for k, w in kinds.items():
        assert max(LABELS, key=lambda x: got[x, w]) == k
    # a text's score is the sum of its words' weights and the intercept
    one = model.transform(df.limit(1)).select("label", "text", "rawPrediction").first()
    base = model.stages[4].interceptVector
    for i, k in enumerate(LABELS):
        assert one["rawPrediction"][i] == pytest.approx(base[i] + sum(got[k, w] for w in one["text"].split()))
