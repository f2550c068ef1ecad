"""Model jobs on MLlib: the fusion classifier, calibration, thresholds, and a text classifier."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..labels import LABELS, NEUTRAL
from ..operators import metrics
from ..operators.sampling import folds
from ..sources.loaders import thresholds_json
from .scoring import FusionModel


def class_weights(rows: DataFrame, label: str = "label", neutral: float | None = None) -> DataFrame:
    """(label, weight): n / (k n_c), or 1 with an own weight for neutral."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # four rows
    n, k = sum(counts.values()), len(counts)
    table = [(c, (neutral if c == NEUTRAL else 1.0) if neutral is not None else n / (k * m)) for c, m in counts.items()]
    return rows.sparkSession.createDataFrame(table, "label string, weight double")


def _prepared(rows: DataFrame, names: tuple[str, ...], neutral: float | None) -> DataFrame:
    weighted = rows.join(F.broadcast(class_weights(rows, neutral=neutral)), "label")
    indexer = StringIndexerModel.from_labels(list(LABELS), inputCol="label", outputCol="target")
    return VectorAssembler(inputCols=list(names), outputCol="raw").transform(indexer.transform(weighted))


def fit_fusion(rows: DataFrame, names: tuple[str, ...], c: float = 1.0, neutral: float | None = None) -> FusionModel:
    """Standardise and multinomial logistic regression with L2. rows: label and a column for each name.

    Strength follows C times the sum of weighted losses plus half the squared norm, so regParam is 1 / (C * sum of weights)."""
    # on disk while the passes over it go on, as LogisticRegression holds what it reads in memory
    data = _prepared(rows, names, neutral).select("target", "weight", "raw").persist(StorageLevel.DISK_ONLY)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data)
    stats = data.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    # MLlib's deviation divides by n - 1; the scale here divides by n
    scale = np.array(scaler.std) * np.sqrt((stats["n"] - 1) / max(stats["n"], 1))
    factor = 1.0 / (c * stats["w"])
    model = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", family="multinomial", regParam=factor, elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-8).fit(scaler.transform(data))
    data.unpersist()
    coef, inter = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    shrink = np.where(np.array(scaler.std) > 0, scale / np.where(np.array(scaler.std) > 0, scaler.std, 1), 0)
    return FusionModel(
        means=dict(zip(names, map(float, scaler.mean))),
        scales=dict(zip(names, map(float, scale))),
        coefficients={k: dict(zip(names, map(float, coef[i] * shrink))) for i, k in enumerate(LABELS)},
        intercepts={k: float(inter[i]) for i, k in enumerate(LABELS)},
        names=tuple(names),
    )


def posteriors(rows: DataFrame, model: FusionModel) -> DataFrame:
    """rows with a column p_<label> for each label."""
    from ..functions.decisions import linear_posterior

    p = linear_posterior({k: F.col(k) for k in model.names}, model.means, model.scales, model.coefficients, model.intercepts)
    return rows.withColumns({f"p_{k}": p[k] for k in LABELS})


def argmax_label(prefix: str = "p_"):  # noqa: ANN201
    from ..functions.decisions import best

    return best({k: F.col(f"{prefix}{k}") for k in LABELS})["label"]


def fit_platt(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Slopes and intercepts for each class's logit. rows: gold, p_<label>."""
    slopes, intercepts = {}, {}
    for k in LABELS:
        p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(f"p_{k}")))
        one = rows.select((F.col("gold") == k).cast("double").alias("target"), F.log(p / (1 - p)).alias("x"))
        data = VectorAssembler(inputCols=["x"], outputCol="features").transform(one)
        m = LogisticRegression(labelCol="target", regParam=1e-6, standardization=False).fit(data)
        slopes[k], intercepts[k] = float(m.coefficients[0]), float(m.intercept)
    return slopes, intercepts


def fit_isotonic(rows: DataFrame) -> dict[str, object]:
    out = {}
    for k in LABELS:
        one = rows.select((F.col("gold") == k).cast("double").alias("target"), F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(f"p_{k}"))).alias("x"))
        out[k] = IsotonicRegression(labelCol="target", featuresCol="features").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(one))
    return out


def apply_isotonic(rows: DataFrame, models: dict[str, object]) -> DataFrame:
    """rows with p_<label> replaced by what each class's isotonic model makes of it, floored at 1e-9 and renormalised."""
    out, names = rows, {k: f"_x_{k}" for k in LABELS}
    for k, x in names.items():
        out = out.withColumn(x, F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(f"p_{k}"))))
        out = models[k].copy().setFeaturesCol(x).setPredictionCol(f"_q_{k}").transform(out)
    q = {k: F.greatest(F.lit(1e-9), F.col(f"_q_{k}")) for k in LABELS}
    total = q[LABELS[0]]
    for k in LABELS[1:]:
        total = total + q[k]
    return out.withColumns({f"p_{k}": v / total for k, v in q.items()}).select(*rows.columns)


def report_then_refit(rows: DataFrame, names: tuple[str, ...], key: str, c: float = 1.0, neutral: float | None = None, k: int = 5) -> tuple[FusionModel, DataFrame]:
    """The fusion model of all rows, and a report by class on the first of k stratified folds by a model that has not seen it."""
    data = folds(rows, key, k)
    seen = fit_fusion(data.where("fold > 0"), names, c, neutral)
    held = posteriors(data.where("fold = 0"), seen).select(F.col("label").alias("gold"), argmax_label().alias("pred"))
    return fit_fusion(rows, names, c, neutral), metrics.class_report(held)


def calibrate_and_tune(rows: DataFrame, sanity: DataFrame | None = None, path: str | None = None, **options) -> tuple[dict[str, float], dict[str, float], dict[str, float], dict]:
    """(slopes, intercepts, thresholds, about): Platt calibration of rows (gold, p_<label>), then thresholds tuned on the calibrated rows
    under the caps on the calibrated sanity rows. path: where the thresholds go as JSON, as loaders.thresholds_table reads them."""
    from ..functions.decisions import platt

    slopes, intercepts = fit_platt(rows)

    def calibrated(df: DataFrame) -> DataFrame:
        p = platt({k: F.col(f"p_{k}") for k in LABELS}, slopes, intercepts)
        return df.withColumns({f"p_{k}": v for k, v in p.items()})

    thresholds, about = tune_thresholds(calibrated(rows), None if sanity is None else calibrated(sanity), **options)
    if path:
        body = thresholds_json({k: F.lit(v) for k, v in thresholds.items()}, F.lit(about["margin"]))
        rows.sparkSession.range(1).select(body.alias("value")).write.mode("overwrite").text(path)
    return slopes, intercepts, thresholds, about


def score_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, f1_macro) of a small table of candidates (candidate, t_<label>, margin). Posts meet the broadcast candidates in one
    aggregation; nothing is collected."""
    x = rows.crossJoin(F.broadcast(candidates))
    passing = F.filter(F.array(*[F.struct((-F.col(f"p_{k}")).alias("minus"), F.lit(k).alias("label"), (F.col(f"p_{k}") >= F.col(f"t_{k}")).alias("ok")) for k in LABELS]), lambda v: v["ok"])
    lead = -F.array_min(F.transform(F.filter(passing, lambda v: v["label"] != NEUTRAL), lambda v: v["minus"]))
    close = (F.col("margin") > 0) & (lead - F.col(f"p_{NEUTRAL}") < F.col("margin"))
    pred = F.when((F.size(passing) == 0) | close, NEUTRAL).otherwise(F.array_min(passing)["label"])
    counted = x.select("candidate", "gold", pred.alias("pred"))
    return metrics.class_report(counted, ("candidate",)).groupBy("candidate").agg(F.avg("f1").alias("f1_macro"))


GRID = tuple(np.round(np.arange(0.08, 0.9225, 0.01), 4).tolist())
MARGINS = tuple(np.round(np.arange(0.0, 0.345, 0.02), 4).tolist())
_ORDER = sorted(LABELS)  # ties go to the smaller name
_QUIET, _LOUD, _OTHER, _GROUPS = 4, 5, 6, 7  # groups of rows beside the four gold labels


_BIASED = [i for i, k in enumerate(_ORDER) if k != NEUTRAL]
_CHUNK = 1 << 17  # rows that meet all drawn candidates at a time
_BITS = 15  # of a place in the grid or among the margins


def _alike(data: DataFrame, steps: np.ndarray, gaps: np.ndarray) -> DataFrame:
    """(places, order, n0 ... n6): rows that no thresholds of the grid and no margin can tell apart, as one, with how many of each group they are.

    places: of the four posteriors in the grid, 15 bits each. order: rank of each class, 2 bits each, the larger first and ties by name, above the
    places of the three leads over neutral among the margins. There are as many of them as the grid tells apart, however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(_ORDER))])
            rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
            places, order = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for i in range(len(_ORDER)):
                places = places << _BITS | np.searchsorted(steps, p[:, i], "right")
                order = order << 2 | rank[:, i]
            for i in _BIASED:
                order = order << _BITS | np.searchsorted(gaps, p[:, i] - p[:, _ORDER.index(NEUTRAL)], "right")
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(order), b.column(len(_ORDER))], ["places", "order", "group"])

    each = [F.count_if(F.col("group") == g).alias(f"n{g}") for g in range(_GROUPS)]
    return data.mapInArrow(run, "places long, order long, group int").groupBy("places", "order").agg(*each)


def _decided(rank: np.ndarray, ok: np.ndarray, lead: np.ndarray, margin: int | None) -> np.ndarray:
    """Number in _ORDER of the label of each row: of the classes that reach their thresholds (ok) the one of least rank; neutral where the best of
    the others leads it by less than the margin, the place of which among all margins is given (None: no margin). lead: places of the leads."""
    neutral = _ORDER.index(NEUTRAL)
    held = np.where(ok, rank, len(_ORDER))
    pred = np.where(ok.any(1), held.argmin(1), neutral)
    if margin is not None:
        others = held[:, _BIASED]
        first = others.argmin(1)
        pred[(others.min(1) < len(_ORDER)) & (lead[np.arange(len(lead)), first] <= margin)] = neutral
    return pred


def _summed(alike: DataFrame, cells: int, count) -> np.ndarray:  # noqa: ANN001
    """Sums over all rows of what count(places, ranks, leads) gives for groups of like rows: the positions, in an array of `cells` numbers, of
    label group 0, and how far apart those of the label groups are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            places, order = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.column_stack([places >> _BITS * i & (1 << _BITS) - 1 for i in reversed(range(len(_ORDER)))])
            rank = np.column_stack([order >> len(_BIASED) * _BITS + 2 * i & 3 for i in reversed(range(len(_ORDER)))])
            lead = np.column_stack([order >> _BITS * i & (1 << _BITS) - 1 for i in reversed(range(len(_BIASED)))])
            many = [(g, b.column(2 + g).to_numpy().astype(float)) for g in range(_GROUPS)]
            many = [(g, m) for g, m in many if m.any()]
            for cell, apart in count(at, rank, lead):
                lo = int(cell.min())
                for g, m in many:
                    here = np.bincount(cell - lo, m).astype(np.int64)  # whole numbers far below 2^53
                    total[lo + g * apart : lo + g * apart + len(here)] += here
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for r in alike.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # some tens of thousands at most
        out[r["cell"]] = r["n"]
    return out


def _added(data: DataFrame, shape: tuple[int, ...], work) -> np.ndarray:  # noqa: ANN001
    """Sum of the arrays that work(posteriors, groups) gives, for some 2^17 rows at a time: each candidate costs a number of calls."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(shape, np.int64), []
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(_ORDER) + 1)])
            if held and (b is None or sum(len(x[0]) for x in held) >= _CHUNK):
                p = np.column_stack([np.concatenate([x[i] for x in held]) for i in range(len(_ORDER))])
                total += work(p, np.concatenate([x[-1] for x in held]))
                held = []
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["cell", "n"])

    out = np.zeros(size, np.int64)
    for r in data.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a few numbers for each candidate
        out[r["cell"]] = r["n"]
    return out.reshape(shape)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as words of 64 bits."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)]).view(np.uint64)


def _drawn_counts(p: np.ndarray, g: np.ndarray, drawn: list[tuple[float, np.ndarray]], steps: np.ndarray) -> np.ndarray:
    """(candidate, group, predicted) counts of rows, by bit slices: 64 rows at a time meet a candidate in a few operations on words."""
    neutral, others = _ORDER.index(NEUTRAL), [i for i, k in enumerate(_ORDER) if k != NEUTRAL]
    reach = [_packed(p[:, c] >= steps[:, None]) for c in range(4)]
    beats = {(a, b): _packed((p[:, a] > p[:, b]) | (p[:, a] == p[:, b]) & (a < b)) for a in range(4) for b in range(4) if a != b}
    present = np.unique(g)
    mine = _packed(g == present[:, None])
    every = _packed(np.ones(len(g), bool))
    # candidates by rising margin: each adds the rows whose lead is below its margin, and not below the one before
    cuts = np.array([gap for gap, _ in drawn])
    lower, rising = {}, {}
    for a in others:
        lead = p[:, a] - p[:, neutral]
        by_lead = np.argsort(lead, kind="stable")
        lower[a], rising[a] = np.zeros_like(every), (by_lead, np.searchsorted(lead[by_lead], cuts, "left"))
    added = dict.fromkeys(others, 0)
    out = np.zeros((len(drawn), _GROUPS, 4), np.int64)
    for i in np.argsort(cuts, kind="stable").tolist():
        gap, t = drawn[i]
        for a in others:
            by_lead, ends = rising[a]
            more = by_lead[added[a] : ends[i]]
            np.bitwise_or.at(lower[a], more >> 6, np.uint64(1) << (more & 63).astype(np.uint64))
            added[a] = max(added[a], int(ends[i]))
        ok = [reach[c][np.searchsorted(steps, t[c])] for c in range(4)]
        pred = [ok[a].copy() for a in range(4)]
        for a, b in beats:
            pred[a] &= ~ok[b] | beats[a, b]
        calm = every & ~(ok[0] | ok[1] | ok[2] | ok[3])
        if gap > 0:
            for a in others:
                lead = ok[a].copy()
                for b in others:
                    if a != b:
                        lead &= ~ok[b] | beats[a, b]
                calm |= lead & lower[a]
        for a in others:
            pred[a] &= ~calm
        pred[neutral] |= calm
        out[i, present] = np.bitwise_count(np.stack(pred)[None] & mine[:, None]).sum(-1)
    return out


def _rated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Macro F1, FPR and FNR from counts (..., group, predicted)."""
    gold = counts[..., :4, :]
    tp = np.diagonal(gold, axis1=-2, axis2=-1)
    both = gold.sum(-1) + counts[..., [0, 1, 2, 3, _OTHER], :].sum(-2)
    neutral = _ORDER.index(NEUTRAL)
    share = lambda x, n: np.where(n > 0, x / np.maximum(n, 1), 0.0)
    quiet, loud = counts[..., _QUIET, :], counts[..., _LOUD, :]
    return share(2 * tp, both).mean(-1), share(quiet.sum(-1) - quiet[..., neutral], quiet.sum(-1)), share(loud[..., neutral], loud.sum(-1))


def tune_thresholds(
    rows: DataFrame,
    sanity: DataFrame | None = None,
    margins: tuple[float, ...] = MARGINS,
    grid: tuple[float, ...] = GRID,
    rounds: int = 10,
    fpr_max: float = 0.2,
    fnr_max: float = 0.2,
    draws: int = 8000,
    seed: int = 42,
) -> tuple[dict[str, float], dict]:
    """(thresholds, about) with the best macro F1 on rows (gold, p_<label>) whose rates on sanity rows (slice_type, ambiguous_stance,
    p_<label>) are within the caps. about: feasible, margin, f1_macro, sanity_fpr, sanity_fnr.

    Coordinate descent for each margin from thresholds of 0.5 (which the grid must hold); it stops when a round changes nothing. A class's
    threshold moves a row between two labels only, so one aggregation by the place of its posterior in the grid scores all values for
    all margins. Rows that grid and margins cannot tell apart are one row there, with how many they are. Where no margin ends within the caps, the best of `draws` random candidates under a penalty is taken: those that the
    sanity rows alone cannot rule out are scored on all rows. Null posteriors are 0."""
    ps = [F.coalesce(F.col(f"p_{k}").cast("double"), F.lit(0.0)).alias(k) for k in _ORDER]
    group = F.lit(_OTHER)
    for i, k in enumerate(_ORDER):
        group = F.when(F.col("gold") == k, i).otherwise(group)
    data = rows.select(*ps, group.alias("group"))
    if sanity is not None:
        kind = F.when(F.col("slice_type").isin(*metrics.INNOCENT), _QUIET).when(F.col("slice_type") == metrics.HARMFUL, _LOUD)
        data = data.unionByName(sanity.where(metrics.not_ambiguous()).select(*ps, kind.alias("group")).where("group IS NOT NULL"))
    data = data.cache()
    steps, n, m = np.array(grid), len(grid), len(margins)
    theta = np.full((m, 4), int(np.argmin(abs(steps - 0.5))))
    ended = np.zeros((m, 3))
    shape = (m, 2, n + 1, _GROUPS, 4)
    gaps = np.unique(np.array(margins, float))
    if max(n, m) >= 1 << _BITS:
        raise ValueError(f"a grid and margins have fewer than {1 << _BITS} values")
    alike = _alike(data, steps, gaps).cache()

    def within(fpr: np.ndarray, fnr: np.ndarray) -> np.ndarray:
        return (fpr <= fpr_max + 1e-9) & (fnr <= fnr_max + 1e-9)

    active = np.ones(m, bool)
    for _ in range(rounds):
        before = theta.copy()
        for c in [_ORDER.index(k) for k in LABELS]:
            todo, held = np.flatnonzero(active).tolist(), theta.copy()

            def count(at: np.ndarray, rank: np.ndarray, lead: np.ndarray, c: int = c, todo: list = todo, held: np.ndarray = held) -> Iterator[tuple[np.ndarray, int]]:
                for j in todo:
                    ok = at > held[j]  # a place is the number of values of the grid that are reached
                    margin = int(np.searchsorted(gaps, margins[j])) if margins[j] > 0 else None
                    for on in (0, 1):
                        ok[:, c] = bool(on)
                        yield ((j * 2 + on) * (n + 1) + at[:, c]) * _GROUPS * 4 + _decided(rank, ok, lead, margin), 4

            got = _summed(alike, int(np.prod(shape)), count).reshape(shape)
            # at value i the rows with place > i reach the threshold
            reach = got[:, 1].sum(1, keepdims=True) - np.cumsum(got[:, 1], 1)
            f, fpr, fnr = _rated(reach[:, :n] + np.cumsum(got[:, 0], 1)[:, :n])
            fine = within(fpr, fnr)
            for j in todo:
                best = theta[j, c]
                top = f[j, best]
                for i in np.flatnonzero(fine[j]):
                    if f[j, i] > top + 1e-8:
                        best, top = i, f[j, i]
                theta[j, c] = best
                ended[j] = f[j, best], fpr[j, best], fnr[j, best]
        active &= (theta != before).any(1)
        if not active.any():
            break
    alike.unpersist()
    best, top = None, -1.0
    for j in range(m):
        if within(ended[j, 1], ended[j, 2]) and ended[j, 0] > top + 1e-12:
            best, top = j, ended[j, 0]
    if best is not None:
        t, margin, (f1, fpr, fnr), relaxed = steps[theta[best]], margins[best], ended[best], False
    else:
        rng = np.random.default_rng(seed)
        drawn = []
        for _ in range(draws):
            gap = float(rng.uniform(0.0, min(max(margins) + 0.001, 0.45)))
            named = {k: float(rng.choice(steps)) for k in LABELS}
            drawn.append((gap, np.array([named[k] for k in _ORDER])))

        def tally(some: list[int], groups: DataFrame) -> tuple[np.ndarray, ...]:
            chosen = [drawn[i] for i in some]

            def work(p: np.ndarray, g: np.ndarray) -> np.ndarray:
                return _drawn_counts(p, g.astype(np.int64), chosen, steps)

            return _rated(_added(groups, (len(some), _GROUPS, 4), work))

        # a macro F1 is at most 1, so a penalty on the sanity rows that is more than 1 above the least one rules a candidate out
        fine = lambda x, y: 500 * np.maximum(0, x - fpr_max) + 500 * np.maximum(0, y - fnr_max)
        _, x, y = tally(list(range(len(drawn))), data.where(F.col("group").isin(_QUIET, _LOUD)))
        left = np.flatnonzero(fine(x, y) <= fine(x, y).min() + 1 + 1e-9).tolist()
        drawn = [drawn[i] for i in left]
        f, x, y = tally(list(range(len(drawn))), data)
        score = f - fine(x, y)
        k = 0
        for i in range(len(drawn)):
            if score[i] > score[k] + 1e-14:
                k = i
        (margin, t), f1, fpr, fnr = drawn[k], f[k], x[k], y[k]
        relaxed = not bool(within(fpr, fnr))
    data.unpersist()
    about = {"feasible": not relaxed, "margin": float(margin), "f1_macro": float(f1), "sanity_fpr": float(fpr), "sanity_fnr": float(fnr)}
    return {k: float(t[_ORDER.index(k)]) for k in LABELS}, about


def text_pipeline(width: int = 1 << 17, reg: float = 1e-3) -> Pipeline:
    """Counts of all words by hash in `width` buckets, IDF, multinomial logistic regression; takes text and label. No word goes by its rank;
    words that share a bucket share a weight."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[a-z0-9']+", gaps=False),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=width),
            IDF(inputCol="counts", outputCol="features"),
            StringIndexerModel.from_labels(list(LABELS), inputCol="label", outputCol="target", handleInvalid="skip"),
            LogisticRegression(labelCol="target", family="multinomial", regParam=reg, maxIter=50),
            IndexToString(inputCol="prediction", outputCol="pred", labels=list(LABELS)),
        ]
    )


def counted(rows: DataFrame, pipeline: Pipeline, *columns: str) -> tuple[DataFrame, Pipeline]:
    """(columns, label and the counts of words, what is left of the text pipeline to fit), so that the texts are read once and go no further."""
    tokenizer, counter, *rest = pipeline.getStages()
    return counter.transform(tokenizer.transform(rows)).select(*columns, "label", "counts"), Pipeline(stages=rest)


def type_scores(scored: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, a column for each label) from the output of a fitted text pipeline."""
    p = vector_to_array("probability")
    return scored.select(key, *[p[i].alias(k) for i, k in enumerate(LABELS)])


def word_weights(model, words: DataFrame) -> DataFrame:  # noqa: ANN001
    """(label, word, weight) of a fitted text pipeline for words (word, each once): coefficient times IDF of the word's bucket, which is
    the score of the word as a text of its own, less the class's intercept."""
    alone = model.transform(words.select("word", F.col("word").alias("text"), F.lit(LABELS[0]).alias("label")))
    raw, base = vector_to_array("rawPrediction"), model.stages[4].interceptVector.toArray()
    each = F.array(*[F.struct(F.lit(k).alias("label"), (raw[i] - float(base[i])).alias("weight")) for i, k in enumerate(LABELS)])
    return alone.select("word", F.explode(each).alias("x")).select("x.label", "word", "x.weight")
