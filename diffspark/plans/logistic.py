"""Many logistic regressions over one table, fitted side by side.

Each model is a *slot*: a training mask of the rows (its fold) and a strength of regularisation.  One scan works out loss and
gradient of every slot: a task adds up its rows for all slots with one matrix product, partial sums meet in a small tree, and the
driver holds one vector a slot.  All slots take their quasi-Newton steps together, so the number of scans is that of the
slowest slot, however many folds and candidates there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a feature matrix that a task works on at once, and groups of tasks whose sums meet before the driver.
CELLS_AT_ONCE, LOTS = 4_000_000, 16
MEMORY, HALVINGS = 10, 30


@dataclass(frozen=True)
class Slot:
    """A model to fit: the place of its training mask in the rows' ``masks`` and its ridge strength."""

    mask: int
    reg: float


@dataclass(frozen=True)
class Models:
    """``weights`` (features by slots) and ``intercepts`` for raw features, and the scans it took."""

    weights: np.ndarray
    intercepts: np.ndarray
    scans: int

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.weights + self.intercepts)


def sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def matrices(batches, features: int, *others: int) -> Iterator[tuple[np.ndarray, list]]:
    """Feature matrices of bounded size with the other columns of their rows; features of different lengths fail."""
    width = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(features)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        width = int(lengths[0]) if width is None else width
        if (lengths != width).any():
            raise ValueError("features must have one length and not be NULL")
        size = max(1, CELLS_AT_ONCE // max(width, 1))
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            matrix = part.column(features).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)
            yield matrix, [part.column(i) for i in others]


def flags(column: pa.Array, width: int) -> np.ndarray:
    """A column of number arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def plus(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    if total is None:
        return part
    if len(total) != len(part):
        raise ValueError("features must have one length and not be NULL")
    return total + part


def _summed(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], masks: int) -> np.ndarray:
    """The sum over all rows of ``work(features, labels, masks)``, a matrix of one row per slot."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for x, (y, mask) in matrices(batches, 0, 1, 2):
            part = work(x, y.to_numpy(zero_copy_only=False).astype(np.float64), flags(mask, masks).astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            pid = TaskContext.get().partitionId()
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([pid % LOTS] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())],
                ["slot", "lot", "part", "total"],
            )

    def add(batches):
        at, total = None, None
        for batch in batches:
            for slot, lot, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if at is not None and at != (slot, lot):
                    yield made(at, total)
                    total = None
                at = (slot, lot)
                total = plus(total, np.frombuffer(raw))
        if at is not None:
            yield made(at, total)

    def made(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "lot", "total"])

    parts = rows.mapInArrow(run, "slot int, lot int, part int, total binary")
    # Sorted, so that reruns add in the same order.
    dealt = parts.repartition("slot", "lot").sortWithinPartitions("slot", "lot", "part")
    # At most LOTS vectors of each slot.
    found = sorted(dealt.mapInArrow(add, "slot int, lot int, total binary").collect())
    out: dict[int, np.ndarray] = {}
    for slot, _, raw in found:
        out[slot] = plus(out.get(slot), np.frombuffer(raw))
    return np.array([out[i] for i in sorted(out)])


def minimise(evaluate, start: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, int]:
    """Minima of many functions by limited-memory quasi-Newton steps, and the number of evaluations.

    ``evaluate`` takes one point per function and returns all losses and gradients.  Each evaluation moves every function that has not
    settled: by a new step, or by half the last one where that did not lower the loss enough.
    """
    x = start.copy()
    loss, gradient = evaluate(x)
    scans, count = 1, len(x)
    open_, steps, halved = np.ones(count, bool), np.zeros(count, int), np.zeros(count, int)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(count)]

    def direction(i: int) -> np.ndarray:
        q, back = gradient[i].copy(), []
        for s, y in reversed(past[i]):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        if past[i]:
            s, y = past[i][-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y), a in zip(past[i], reversed(back), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    move = np.array([direction(i) for i in range(count)])
    length = np.ones(count)
    open_ &= np.linalg.norm(gradient, axis=1) > tolerance
    while open_.any() and max_iter:
        trial = x + np.where(open_, length, 0.0)[:, None] * move
        new_loss, new_gradient = evaluate(trial)
        scans += 1
        for i in np.flatnonzero(open_):
            if not new_loss[i] <= loss[i] + 1e-4 * length[i] * (gradient[i] @ move[i]):
                length[i] /= 2
                halved[i] += 1
                open_[i] = halved[i] < HALVINGS
                continue
            s, y = trial[i] - x[i], new_gradient[i] - gradient[i]
            if s @ y > 1e-12 * (y @ y):
                past[i] = [*past[i][1 - MEMORY :], (s, y)]
            gained = loss[i] - new_loss[i]
            x[i], loss[i], gradient[i] = trial[i], new_loss[i], new_gradient[i]
            steps[i] += 1
            settled = gained <= tolerance * max(1.0, abs(loss[i])) or np.linalg.norm(gradient[i]) <= tolerance
            open_[i] = not settled and steps[i] < max_iter
            move[i], length[i], halved[i] = direction(i), 1.0, 0
    return x, scans


def fit(rows: DataFrame, slots: Sequence[Slot], masks: int, max_iter: int = 20, tolerance: float = 1e-6) -> Models:
    """Ridge logistic regressions over ``rows (features array, label 0/1, masks array of 0/1)``, one per slot.

    Features are standardised by each mask's own rows and the ridge acts on the standardised weights, never on the intercept.  A
    feature without variance has weight 0; a mask of one class gives that class with certainty; a mask without rows fails.
    """
    table = rows.select("features", "label", F.col("masks").cast("array<int>").alias("masks"))

    def moments(x, y, mask):
        return np.column_stack([mask.sum(0), mask.T @ y, mask.T @ x, mask.T @ (x * x)])

    sums = _summed(table, moments, masks)
    empty = [i for i in range(masks) if not len(sums) or sums[i, 0] == 0]
    if empty:
        raise ValueError(f"no training rows in mask {empty[0]}")
    width = (sums.shape[1] - 2) // 2
    n, positives = sums[:, 0], sums[:, 1]
    mean = sums[:, 2 : 2 + width] / n[:, None]
    variance = np.maximum(sums[:, 2 + width :] / n[:, None] - mean**2, 0.0) * (n / np.maximum(n - 1, 1))[:, None]
    # What is left of equal values by rounding is no variance.
    deviation = np.where(variance > 1e-12 * mean**2, np.sqrt(variance), 0.0)
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)

    of = np.array([s.mask for s in slots])
    reg = np.array([s.reg for s in slots])
    mixed = (positives > 0) & (positives < n)
    start = np.zeros((len(slots), width + 1))
    with np.errstate(divide="ignore"):
        odds = np.log(positives / n) - np.log1p(-positives / n)
    start[:, -1] = np.where(mixed, odds, 0.0)[of]

    def raw(points):
        weights = points[:, :-1] * scale[of]
        return weights, points[:, -1] - (weights * mean[of]).sum(1)

    def evaluate(points):
        weights, intercepts = raw(points)

        def work(x, y, mask):
            z = x @ weights.T + intercepts
            own = mask[:, of]
            residual = (sigmoid(z) - y[:, None]) * own
            loss = (np.logaddexp(0.0, z) - y[:, None] * z) * own
            return np.column_stack([residual.T @ x, residual.sum(0), loss.sum(0)])

        total = _summed(table, work, masks) / n[of][:, None]
        slope = total[:, -2]
        inner = (total[:, :-2] - slope[:, None] * mean[of]) * scale[of] + reg[:, None] * points[:, :-1]
        loss = total[:, -1] + 0.5 * reg * (points[:, :-1] ** 2).sum(1)
        fixed = ~mixed[of]
        gradient = np.column_stack([inner, slope])
        gradient[fixed], loss[fixed] = 0.0, 0.0
        return loss, gradient

    points, scans = minimise(evaluate, start, max_iter, tolerance)
    weights, intercepts = raw(points)
    weights[~mixed[of]] = 0.0
    intercepts = np.where(mixed[of], intercepts, odds[of])
    return Models(weights.T.copy(), intercepts, scans + 1)
