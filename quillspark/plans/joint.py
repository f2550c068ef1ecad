"""Many fusion models at once: every candidate and every fold is fitted in the same passes over the rows.

A fit is multinomial logistic regression with L2 over standardised features, as in `training.fit_fusion`. One aggregation by fold gives
the means, scales and class weights of all training sets, since those of "all but fold i" are sums less those of fold i. Then each
pass hands back the loss and the gradient of every fit, stacked, and the driver takes one L-BFGS step for each of them, from the second
derivatives of the first fit with the same class weights: fits differ by a fold and a penalty, so these are near their own, and a fit takes about
as many passes as by Newton's method. What moves is a few numbers for each fit and core, whatever the number of rows. Fits that have converged
leave the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..labels import LABELS, NEUTRAL
from ..operators import metrics
from ..operators.sampling import folds
from .scoring import FusionModel

K = len(LABELS)
MEMORY, PASSES, TOLERANCE = 3, 400, 1e-9
CHUNK = 2048  # rows that meet all fits at a time


@dataclass(frozen=True)
class Fit:
    """One model: strength 1/c of the penalty, weight of the neutral class (None: balanced classes), and the fold it does not see."""

    c: float
    neutral: float | None
    without: int | None


@dataclass
class _Set:
    """What a training set needs: means, scales, class weights and their total."""

    mean: np.ndarray
    scale: np.ndarray
    count: np.ndarray

    def weights(self, neutral: float | None) -> np.ndarray:
        n, k = self.count.sum(), int((self.count > 0).sum())
        if neutral is not None:
            return np.array([neutral if x == NEUTRAL else 1.0 for x in LABELS])
        return np.where(self.count > 0, n / (max(k, 1) * np.maximum(self.count, 1)), 0.0)


def _class() -> Column:
    return F.coalesce(*[F.when(F.col("label") == k, i) for i, k in enumerate(LABELS)])


def _vector(names: tuple[str, ...]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def _numbers(data: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(fold, y, x): label number and features as an array; rows of other labels are left out."""
    return data.select(F.col("fold").cast("int").alias("fold"), _class().alias("y"), _vector(names).alias("x")).where("y IS NOT NULL")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(data: DataFrame, size: int, work) -> np.ndarray:  # noqa: ANN001
    """The sum over all rows of what work(fold, y, x) gives, `size` numbers; one row of them comes back from each core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                fold, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b, 2)
                for i in range(0, len(y), CHUNK):
                    total += work(fold[i : i + CHUNK], y[i : i + CHUNK], x[i : i + CHUNK])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    cores = data.sparkSession.sparkContext.defaultParallelism
    return sum((np.frombuffer(r["v"]) for r in data.coalesce(cores).mapInArrow(run, "v binary").collect()), np.zeros(size))


def _sets(data: DataFrame, d: int, k: int) -> dict[int | None, _Set]:
    """The training sets without each of k folds, and the whole."""
    wide = 2 * d + K

    def first(fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((k, wide))
        for f in range(k):
            mine = fold == f
            out[f, :d], out[f, 2 * d :] = x[mine].sum(0), np.bincount(y[mine], minlength=K)
        return out.ravel()

    sums = _summed(data, k * wide, first).reshape(k, wide)
    centre = sums[:, :d].sum(0) / max(sums[:, 2 * d :].sum(), 1)

    def second(fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[fold == f] - centre) ** 2).sum(0) for f in range(k)]).ravel()

    squares = _summed(data, k * d, second).reshape(k, d)
    out = {}
    for f in (None, *range(k)):
        use = np.arange(k) != (-1 if f is None else f)
        count = sums[use, 2 * d :].sum(0)
        n = max(count.sum(), 1)
        mean = sums[use, :d].sum(0) / n
        var = squares[use].sum(0) / n - (mean - centre) ** 2
        out[f] = _Set(mean, np.sqrt(np.where(var > 1e-18 * np.maximum(1, centre**2), var, 0)), count)
    return out


def _standard(x: np.ndarray, s: _Set) -> np.ndarray:
    z = np.where(s.scale > 0, (x - s.mean) / np.where(s.scale > 0, s.scale, 1), 0.0)
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _move(whole: _Set, s: _Set) -> np.ndarray:
    """The matrix that takes rows standardised by the whole to rows standardised by s."""
    real = (whole.scale > 0) & (s.scale > 0)
    by = np.where(real, whole.scale / np.where(real, s.scale, 1), 0.0)
    out = np.diag(np.append(by, 1.0))
    out[-1, :-1] = np.where(real, (whole.mean - s.mean) / np.where(real, s.scale, 1), 0.0)
    return out


def _passes(data: DataFrame, fits: list[Fit], sets: dict[int | None, _Set], d: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Loss and gradient of each fit at its parameters `at` (fits, K, d + 1), in one pass over the rows, and about its second derivatives: those
    of the first fit with its class weights, with its own scales and penalty."""
    whole = sets[None]
    weights = np.stack([sets[f.without].weights(f.neutral) for f in fits])
    moves = np.stack([_move(whole, sets[f.without]) for f in fits])
    theta = (at @ moves.transpose(0, 2, 1)).transpose(1, 2, 0).copy()
    hidden = np.array([-1 if f.without is None else f.without for f in fits])
    firsts = {f.neutral: i for i, f in reversed(list(enumerate(fits)))}
    m, e = len(fits), d + 1
    pairs = [(a, b) for a in range(K) for b in range(a, K)]

    def work(fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z, row = _standard(x, whole), np.arange(len(y))
        scores = z @ theta  # class, row, fit
        top = scores.max(0)
        p = np.exp(scores - top)
        total = p.sum(0)
        w = weights.T[y] * (fold[:, None] != hidden)
        loss = (w * (np.log(total) + top - scores[y, row])).sum(0)
        p /= total
        curves = [z.T @ ((w[:, i] * p[a, :, i] * (float(a == b) - p[b, :, i]))[:, None] * z) for i in firsts.values() for a, b in pairs]
        p[y, row] -= 1
        p *= w
        return np.concatenate([loss, (p.transpose(0, 2, 1) @ z).ravel(), np.ravel(curves)])

    got = _summed(data, m + K * m * e + len(firsts) * len(pairs) * e * e, work)
    total = np.array([(weights[i] * sets[f.without].count).sum() for i, f in enumerate(fits)])
    total = np.where(total > 0, total, 1.0)
    loss, grad = got[:m] / total, got[m : m + K * m * e].reshape(K, m, e).transpose(1, 0, 2) @ moves / total[:, None, None]
    strength = np.array([1 / (f.c * n) for f, n in zip(fits, total)])
    loss += strength * 0.5 * (at[:, :, :d] ** 2).sum((1, 2))
    grad[:, :, :d] += strength[:, None, None] * at[:, :, :d]
    shared = {}
    for (neutral, i), blocks in zip(firsts.items(), got[m + K * m * e :].reshape(len(firsts), len(pairs), e, e)):
        curve = np.zeros((K, e, K, e))
        for (a, b), block in zip(pairs, blocks):
            curve[a, :, b], curve[b, :, a] = block, block.T
        shared[neutral] = curve.reshape(K * e, K * e) / total[i]
    curves, own = [], np.arange(K * e) % e == d
    for i, f in enumerate(fits):
        to = np.kron(np.eye(K), moves[i])
        # equal steps of all intercepts change nothing, so any curve will do for them
        curves.append(to.T @ shared[f.neutral] @ to + np.diag(np.where(own, 0.0, strength[i])) + np.outer(own, own))
    return loss, grad, curves


class _Lbfgs:
    """One fit's way downhill: asks for the loss at `trial`, takes it or halves the step. The first guess of the second derivatives is told."""

    def __init__(self, size: int):
        self.x, self.loss, self.grad = np.zeros(size), np.inf, np.zeros(size)
        self.trial, self.steps, self.done = self.x.copy(), [], False
        self.direction, self.size = np.zeros(size), 1.0

    def told(self, loss: float, grad: np.ndarray, curve: np.ndarray) -> None:
        slope, noise = self.grad @ self.direction, 1e-13 * abs(self.loss)
        if np.isfinite(self.loss) and loss > self.loss + 1e-4 * self.size * slope + noise and self.size > 1e-6:
            self.size /= 2
            self.trial = self.x + self.size * self.direction
            return
        if np.isfinite(self.loss):
            s, y = self.trial - self.x, grad - self.grad
            if s @ y > 1e-14:
                self.steps = [*self.steps[-MEMORY + 1 :], (s, y)]
            if loss >= self.loss and self.size <= 1e-6:
                self.done = True  # no way down that can be measured
                return
        self.x, self.loss, self.grad = self.trial, loss, grad
        if np.abs(grad).max() < TOLERANCE:
            self.done = True
            return
        q, alphas = grad.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q = np.linalg.solve(curve, q)
        for (s, y), a in zip(self.steps, reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        self.direction, self.size = -q, 1.0
        self.trial = self.x + self.size * self.direction


def fit_all(data: DataFrame, names: tuple[str, ...], fits: list[Fit], k: int, passes: int = PASSES) -> list[FusionModel]:
    """The models of all fits. data: label, fold (0 to k - 1) and a column for each name; it is made once and read once for each pass."""
    rows = _numbers(data, names).persist()
    out = _fitted(rows, names, fits, k, passes)
    rows.unpersist()
    return out


def _fitted(rows: DataFrame, names: tuple[str, ...], fits: list[Fit], k: int, passes: int = PASSES) -> list[FusionModel]:
    """fit_all over what _numbers gives."""
    d = len(names)
    sets = _sets(rows, d, k)
    ways = [_Lbfgs(K * (d + 1)) for _ in fits]
    for _ in range(passes):
        on = [i for i, w in enumerate(ways) if not w.done]
        if not on:
            break
        loss, grad, curves = _passes(rows, [fits[i] for i in on], sets, d, np.stack([ways[i].trial for i in on]).reshape(len(on), K, d + 1))
        for j, i in enumerate(on):
            ways[i].told(float(loss[j]), grad[j].ravel(), curves[j])
    out = []
    for f, way in zip(fits, ways):
        s, at = sets[f.without], way.x.reshape(K, d + 1)
        real = s.scale > 0
        out.append(
            FusionModel(
                means=dict(zip(names, s.mean.tolist())),
                scales=dict(zip(names, np.where(real, s.scale, 0.0).tolist())),
                coefficients={c: dict(zip(names, at[i, :d].tolist())) for i, c in enumerate(LABELS)},
                intercepts={c: float(at[i, d] - at[:, d].mean()) for i, c in enumerate(LABELS)},
                names=tuple(names),
            )
        )
    return out


def _stacked(models: list[FusionModel], names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    mean, scale = (np.array([[m[n] for n in names] for m in x]) for x in ([m.means for m in models], [m.scales for m in models]))
    coef = np.array([[[*(m.coefficients[c][n] for n in names), m.intercepts[c]] for c in LABELS] for m in models])
    return mean, scale, coef


def _posterior(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return _softmax(_standard(x, _Set(mean, scale, np.zeros(K))) @ coef.T)


def _best(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """The likeliest class of each row by each of some models of one training set."""
    return (_standard(x, _Set(mean, scale, np.zeros(K))) @ coefs.transpose(0, 2, 1)).argmax(-1).T


def cross_fit(rows: DataFrame, names: tuple[str, ...], key: str, k: int = 5, c: float = 1.0, neutral: float | None = None) -> DataFrame:
    """(key, fold, label, p_<label>): each row's posterior by the model of the other folds, so calibration and thresholds can be fitted on
    posteriors that no model has seen. Folds are stratified by label."""
    # what it is made from is read twice, by counts and by ranks
    known = rows.where(F.col("label").isin(*LABELS)).select(key, "label", _vector(names).alias("x")).persist(StorageLevel.DISK_ONLY)
    flat = folds(known, key, k).select(F.col(key).alias("key"), F.col("fold").cast("int").alias("fold"), "label", "x").persist()
    mean, scale, coef = _stacked(_fitted(flat.select("fold", _class().alias("y"), "x"), names, [Fit(c, neutral, i) for i in range(k)], k), names)
    known.unpersist()
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, x = b.column(1).to_numpy(zero_copy_only=False), _matrix(b, 3)
            p = np.zeros((b.num_rows, K))
            for i in range(k):
                mine = fold == i
                p[mine] = _posterior(x[mine], mean[i], scale[i], coef[i])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(p[:, i]) for i in range(K))], ["key", "fold", "label", *(f"p_{c}" for c in LABELS)])

    return flat.mapInArrow(run, f"key {kind}, fold int, label string, " + ", ".join(f"p_{c} double" for c in LABELS)).withColumnRenamed("key", key)


def search(rows: DataFrame, names: tuple[str, ...], key: str, grid: tuple[float, ...] = (0.1, 1.0, 10.0), neutrals: tuple[float | None, ...] = (None, 0.8), k: int = 4, sanity: DataFrame | None = None, penalty: float = 0.22) -> DataFrame:
    """(place, c, neutral, cv_macro_f1, sanity_fpr, objective): candidates by objective, then by lower FPR, then as listed.

    objective: macro F1 over the folds' means, each fold by the model of the others, less penalty times the false positive rate on sanity rows
    (slice_type, ambiguous_stance and the features) of the candidate's model of all rows. All fits share their passes; all candidates are
    judged in one."""
    numbers = _numbers(folds(rows, key, k), names).persist()
    candidates = [(c, n) for c in grid for n in neutrals]
    fits = [Fit(c, n, f) for c, n in candidates for f in range(k)] + ([Fit(c, n, None) for c, n in candidates] if sanity is not None else [])
    models = _fitted(numbers, names, fits, k)
    m = len(candidates)
    mean, scale, coef = _stacked(models, names)
    coef_f = coef[: m * k].reshape(m, k, K, -1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((m, k, K, K), np.int64)
        for b in batches:
            fold, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b, 2)
            for i in range(k):
                mine = fold == i
                best = _best(x[mine], mean[i], scale[i], coef_f[:, i])
                for j in range(m):
                    cells[j, i] += np.bincount(y[mine] * K + best[:, j], minlength=K * K).reshape(K, K)
        j, i, g, p = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (j, i, g, p, cells[j, i, g, p])], ["candidate", "fold", "g", "p", "n"])

    cells = np.zeros((m, k, K, K))
    for r in numbers.mapInArrow(judge, "candidate long, fold long, g long, p long, n long").groupBy("candidate", "fold", "g", "p").agg(F.sum("n").alias("n")).collect():
        cells[r["candidate"], r["fold"], r["g"], r["p"]] = r["n"]
    tp, both = np.diagonal(cells, axis1=2, axis2=3), cells.sum(2) + cells.sum(3)
    f1 = np.where(both > 0, 2 * tp / np.maximum(both, 1), 0.0).mean(2).mean(1)
    fpr = np.zeros(m)
    if sanity is not None:

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b, 2)
                best = _best(x, mean[-1], scale[-1], coef[m * k :])
                preds = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * m + 1, m), pa.int32()), pa.array(np.array(LABELS, object)[best.ravel()], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), preds], ["slice_type", "ambiguous_stance", "preds"])

        flat = sanity.select(F.col("slice_type").cast("string"), F.col("ambiguous_stance").cast("string"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
        said = flat.mapInArrow(decide, "slice_type string, ambiguous_stance string, preds array<string>").select("slice_type", "ambiguous_stance", F.posexplode("preds").alias("candidate", "pred"))
        for r in metrics.sanity_rates(said, ("candidate",)).collect():
            fpr[r["candidate"]] = r["fpr"]
    numbers.unpersist()
    order = sorted(range(m), key=lambda j: (-(f1[j] - penalty * fpr[j]), fpr[j], j))
    out = [(n + 1, *candidates[j], float(f1[j]), float(fpr[j]), float(f1[j] - penalty * fpr[j])) for n, j in enumerate(order)]
    return rows.sparkSession.createDataFrame(out, "place int, c double, neutral double, cv_macro_f1 double, sanity_fpr double, objective double")
