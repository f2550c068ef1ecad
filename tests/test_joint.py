"""Joint fits against separate ones, out-of-fold posteriors, ranged AUC, and required literals against the engine."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import factors, features, rules
from quillspark.functions import lexicons as lex
from quillspark.labels import LABELS
from quillspark.operators import metrics
from quillspark.operators.sampling import folds
from quillspark.plans import joint, training

NAMES = ("x0", "x1", "x2", "x3", "flat")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [(i, LABELS[i % 4 if i % 9 else 3], "neutral_policy" if i % 4 == 3 else "explicit_or_implicit_bias", "1" if i % 10 == 0 else "0", *(float(i % 4 == k) * 0.8 + rng.gauss(0, 1) for k in range(4)), 2.0) for i in range(160)]
    return spark.createDataFrame(out, "post_id long, label string, slice_type string, ambiguous_stance string, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def apart(spark, rows, a, b):
    """Largest difference of two models' posteriors."""
    one, two = (training.posteriors(rows, m).orderBy("post_id").select(*[f"p_{k}" for k in LABELS]).toPandas().to_numpy() for m in (a, b))
    return np.abs(one - two).max()


def test_joint_fits_equal_separate_ones(spark, rows):
    data = folds(rows, "post_id", 4).cache()
    fits = [joint.Fit(c, n, f) for c in (0.1, 10.0) for n in (None, 0.8) for f in (0, 3, None)]
    together = joint.fit_all(data, NAMES, fits, 4)
    pdf = data.toPandas()
    for f, model in zip(fits, together):
        # the gradient of the stated objective is 0 there
        seen = pdf if f.without is None else pdf[pdf["fold"] != f.without]
        x, y = seen[list(NAMES)].to_numpy(), np.array([LABELS.index(v) for v in seen["label"]])
        sd = x.std(0)
        z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
        w = np.array([f.neutral if k == "neutral" else 1.0 for k in LABELS])[y] if f.neutral else (len(y) / (4 * np.bincount(y, minlength=4)))[y]
        coef = np.array([[model.coefficients[k][n] for n in NAMES] for k in LABELS])
        s = z @ coef.T + [model.intercepts[k] for k in LABELS]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        assert np.abs((p * w[:, None]).T @ z + coef / f.c).max() < 1e-5 and np.abs((p * w[:, None]).sum(0)).max() < 1e-5
    for i in (0, 9):
        f = fits[i]
        assert apart(spark, rows, together[i], joint.fit_all(data, NAMES, [f], 4)[0]) < 1e-6
    # MLlib's scale divides by n - 1, so its penalty is a little weaker
    assert apart(spark, rows, together[-1], training.fit_fusion(rows, NAMES, fits[-1].c, fits[-1].neutral)) < 2e-3


def test_few_passes_where_features_nearly_say_the_same(spark, rows, monkeypatch):
    names, taken, passes = ("x0", "x1", "both", "near", "flat"), [], joint._passes
    alike = rows.withColumn("both", F.col("x0") + F.col("x1")).withColumn("near", F.col("x0") + F.col("x2") / 1000)
    data = folds(alike, "post_id", 4).cache()
    monkeypatch.setattr(joint, "_passes", lambda *a: taken.append(len(a[1])) or passes(*a))
    fits = [joint.Fit(c, n, f) for c in (0.1, 1000.0) for n in (None, 0.8) for f in (0, 1, None)]
    together = joint.fit_all(data, names, fits, 4)
    assert len(taken) <= 25 and taken[0] == len(fits)
    pdf = data.toPandas()
    for f, model in zip(fits, together):
        seen = pdf if f.without is None else pdf[pdf["fold"] != f.without]
        x, y = seen[list(names)].to_numpy(), np.array([LABELS.index(v) for v in seen["label"]])
        z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), np.inf)
        w = np.array([f.neutral if k == "neutral" else 1.0 for k in LABELS])[y] if f.neutral else (len(y) / (4 * np.bincount(y, minlength=4)))[y]
        coef = np.array([[model.coefficients[k][n] for n in names] for k in LABELS])
        p = joint._softmax(z @ coef.T + [model.intercepts[k] for k in LABELS])
        p[np.arange(len(y)), y] -= 1
        assert np.abs((p * w[:, None]).T @ z + coef / f.c).max() < 1e-5


def test_a_class_without_rows_and_one_that_features_tell_apart(spark, rows, monkeypatch):
    taken, passes = [], joint._passes
    monkeypatch.setattr(joint, "_passes", lambda *a: taken.append(len(a[1])) or passes(*a))
    data = folds(rows.where("label <> 'gender_bias'").withColumn("tells", (F.col("label") == "neutral").cast("double")), "post_id", 4)
    models = joint.fit_all(data, (*NAMES, "tells"), [joint.Fit(100.0, n, f) for n in (None, 0.8) for f in (0, None)], 4)
    assert len(taken) <= 60
    for m in models:
        got = training.posteriors(data, m).withColumn("pred", training.argmax_label()).toPandas()
        assert got["p_gender_bias"].max() < 1e-3 or m is not models[1]
        assert ((got["label"] == "neutral") == (got["pred"] == "neutral")).all() and np.isfinite(got[[f"p_{k}" for k in LABELS]].to_numpy()).all()


def test_a_row_is_scored_by_a_model_that_has_not_seen_it(spark, rows):
    got = joint.cross_fit(rows, NAMES, "post_id", k=4)
    assert got.count() == rows.count() and got.groupBy("post_id").count().where("count > 1").isEmpty()
    # another label for the rows of one fold changes the models of all others, not theirs
    first = {r["post_id"] for r in got.where("fold = 0").collect()}
    data = folds(rows, "post_id", 4).cache()
    turned = data.withColumn("label", F.when(F.col("fold") == 0, F.lit("neutral")).otherwise(F.col("label")))
    same = joint.fit_all(turned, NAMES, [joint.Fit(1.0, None, 0)], 4)[0]
    want = {r["post_id"]: [r[f"p_{k}"] for k in LABELS] for r in training.posteriors(rows, same).collect()}
    for r in got.where("fold = 0").collect():
        assert [r[f"p_{k}"] for k in LABELS] == pytest.approx(want[r["post_id"]], abs=1e-9)
    assert 30 < len(first) < 50


def test_search_ranks_by_objective(spark, rows):
    got = joint.search(rows, NAMES, "post_id", grid=(0.1, 1.0), k=4, sanity=rows).collect()
    assert [r["place"] for r in got] == [1, 2, 3, 4]
    assert [(-r["objective"], r["sanity_fpr"]) for r in got] == sorted((-r["objective"], r["sanity_fpr"]) for r in got)
    best, data = got[0], folds(rows, "post_id", 4).cache()
    f1 = []
    for i in range(4):
        model = joint.fit_all(data, NAMES, [joint.Fit(best["c"], best["neutral"], i)], 4)[0]
        held = training.posteriors(data.where(F.col("fold") == i), model).select(F.col("label").alias("gold"), training.argmax_label().alias("pred"))
        f1.append(metrics.multiclass_summary(held).first()["f1_macro"])
    assert best["cv_macro_f1"] == pytest.approx(sum(f1) / 4)
    whole = joint.fit_all(data, NAMES, [joint.Fit(best["c"], best["neutral"], None)], 4)[0]
    fpr = metrics.sanity_rates(training.posteriors(rows, whole).withColumn("pred", training.argmax_label())).first()["fpr"]
    assert best["sanity_fpr"] == pytest.approx(fpr)


def test_ranged_auc(spark):
    rng = random.Random(5)
    made = [(lab, rng.randint(0, 1), round(rng.random() ** 6, 4)) for lab in ("a", "b", None) for _ in range(3000)]
    df = spark.createDataFrame(made, "label string, positive int, score double")
    for lab in ("a", "b", None):
        mine = [(p, s) for x, p, s in made if x == lab]
        pos, neg = np.array([s for p, s in mine if p]), np.array([s for p, s in mine if not p])
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert {r["label"]: r["auc"] for r in metrics.roc_auc(df).collect()}[lab] == pytest.approx(want)
        levels, ap = sorted({s for _, s in mine}, reverse=True), 0.0
        for v in levels:
            tp, seen = (pos >= v).sum(), (pos >= v).sum() + (neg >= v).sum()
            ap += (pos == v).sum() / len(pos) * tp / seen
        assert {r["label"]: r["average_precision"] for r in metrics.pr_auc(df).collect()}[lab] == pytest.approx(ap)
    assert metrics.roc_auc(df.where("false")).count() == 0
    one = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5)], "label string, positive int, score double")
    assert metrics.roc_auc(one).first()["auc"] == 0.5


def phrases(rng, n):
    """Texts that hold words of the patterns, in places where they match and where they nearly do."""
    words = sorted({w for v in vars(lex).values() if isinstance(v, (str, tuple)) for p in ([v] if isinstance(v, str) else v) if isinstance(p, str) for w in re.findall(r"[a-z]{2,}", p)})
    joins = [" ", "  ", "-", ", ", "'", ". ", "\n", ""]
    return ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(1, 14))) for _ in range(n)] + ["", " ", "KKelvin men are usually bad", "ſhould not hire ſtaff", "WOMEN ARE Usually Lazy", "don't say", "İn general"]


def test_index_changes_no_result(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*phrases(random.Random(3), 400), None])], "i int, text string").withColumn("w", factors.index(F.col("text"))).cache()
    t, w = F.col("text"), "w"
    flags = {k: F.lit(1) for k in rules.FLAG_NAMES}

    def everything(words):
        out = {**rules.flags(t, words), **features.linguistic(t, flags, words), **features.stance(t, words), **features.methodology(t, words)}
        return df.select("i", *[c.alias(k) for k, c in out.items()], rules.heuristics(t, words).alias("heur"), rules.critique(F.coalesce(t, F.lit("")), words).alias("critique")).orderBy("i").collect()

    plain, indexed = everything(None), everything(w)
    assert plain == indexed
    assert sum(r["heur"]["has_comparison"] for r in plain) > 5 and sum(r["generalisation"] for r in plain) > 5


def test_required_literals():
    assert factors.required(r"\bbetter\s+than\b") == (" better than ",)
    assert factors.required(r"\bprefer(?:s|red|ring)?\b") == (" prefer",)
    assert set(factors.required(r"\b(?:wom[ae]n|he)\b")) == {" woman ", " women ", " he "}
    assert factors.required(r"\w+|\bmen\b") is None
