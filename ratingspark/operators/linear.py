"""Linear raters: squared-hinge support vector machines, all classes, targets and folds fitted at once.

Each problem minimises ``|w|^2 / 2 + C * sum(max(0, 1 - y * (w . x))^2)`` over its rows, x with a constant 1 at its end (so
the constant's weight is penalised too). The function is convex and piecewise quadratic, so Newton's method ends after a
few steps: one step is one Spark job in which every task adds up value and gradient of all unfinished problems over its rows, and what
their Hessians gain and lose, and the driver solves their small linear systems. A Hessian is the sum over the rows inside the margin, so only
rows that came in or went out since the last point are added or taken off. What is sent grows with the problems and the square of the
dimensions, never with the rows. A step that does not lower its value is halved, and the next Hessian is added up anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows laid out as one matrix at a time.
BLOCK = 512
#: Partial sums of a key meet in this many places before they meet in one.
SPREAD = 32


class Problem(NamedTuple):
    """Class ``label`` of the target column ``target`` against the rest, on the rows and features of view ``model``."""

    model: int
    target: str
    label: int


class View(NamedTuple):
    """A block of rows as one model sees it: features, which rows it is trained on, and the targets (NaN: none)."""

    model: int
    features: np.ndarray
    trained: np.ndarray
    targets: dict[str, np.ndarray]


Views = Callable[[pa.RecordBatch], Iterator[View]]


def summed(rows: DataFrame, parts: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Adds up the vectors that ``parts`` yields for the batches of ``rows``, by their number: first in each task, then in
    ``SPREAD`` places, then in one. The result (numbers times vector length) goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in parts(b):
                total[i] = total[i] + v if i in total else v
        for i, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["part", "v"])

    sent = rows.mapInArrow(run, "part int, v array<double>").select(
        "part", array_to_vector("v").alias("v"), (F.spark_partition_id() % SPREAD).alias("place"))
    halfway = sent.groupBy("part", "place").agg(Summarizer.sum(F.col("v")).alias("v"))
    table = halfway.groupBy("part").agg(Summarizer.sum(F.col("v")).alias("v")).select("part", vector_to_array("v").alias("v")).toArrow()
    return {i: v.values.to_numpy() for i, v in zip(table["part"].to_pylist(), table["v"], strict=True)}


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def target_values(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, last: np.ndarray, fresh: np.ndarray):
    """Of problems with the labels y, points w and last points (a column each): values and gradients (rows) of
    sum(max(0, 1 - y (w . x))^2) and, where it changed, (column, change of half the Hessian) since the last point. The Hessian of a ``fresh`` one was 0."""
    slack = 1 - y * (x @ w)
    active, was = slack > 0, (1 - y * (x @ last) > 0) & ~fresh
    r = np.where(active, y * slack, 0.0)
    whole = None
    changes = []
    for j in range(y.shape[1]):
        moved = np.flatnonzero(active[:, j] != was[:, j])
        if not len(moved):
            continue
        if len(moved) == len(x) and active[:, j].all():  # at zero all classes hold all rows
            whole = x.T @ x if whole is None else whole
            changes.append((j, whole))
        else:
            part = x[moved]
            changes.append((j, part.T @ (part * np.where(active[moved, j], 1.0, -1.0)[:, None])))
    return np.einsum("ij,ij->j", r, r), -2 * (r.T @ x), changes


def solve(rows: DataFrame, views: Views, problems: list[Problem], dims: dict[int, int], c: float | dict[Problem, float] = 1.0,
          tol: float = 1e-9, max_iter: int = 60) -> dict[Problem, np.ndarray]:
    """The weights of every problem (the constant's last). ``dims`` are the features of each model, ``c`` the cost of all
    or of each problem. A problem is finished when its gradient is below ``tol`` times that at zero."""
    cost = c if isinstance(c, dict) else dict.fromkeys(problems, c)
    at = {p: np.zeros(dims[p.model] + 1) for p in problems}  # the best point so far
    step: dict[Problem, tuple[np.ndarray, float]] = {}  # direction and value of the best point
    first: dict[Problem, float] = {}
    trial, out = dict(at), {}
    last: dict[Problem, np.ndarray] = {}  # the points that the Hessians are of
    corners: dict[Problem, np.ndarray] = {}  # the Hessians' upper halves, without cost and penalty
    for _ in range(max_iter):
        if not trial:
            break
        asked = list(trial.items())
        groups: dict[int, dict[str, list[int]]] = {}
        for i, (p, _) in enumerate(asked):
            groups.setdefault(p.model, {}).setdefault(p.target, []).append(i)

        def parts(batch, asked=asked, groups=groups, last=dict(last)):
            for view in views(batch):
                if view.model not in groups:
                    continue
                x = with_constant(view.features[view.trained])
                corner = np.triu_indices(x.shape[1])
                for target, mine in groups[view.model].items():
                    known = view.targets[target][view.trained]
                    has = ~np.isnan(known)
                    rows_ = x if has.all() else x[has]
                    y = np.where(known[has][:, None] == [asked[i][0].label for i in mine], 1.0, -1.0)
                    w = np.stack([asked[i][1] for i in mine], axis=1)
                    before = np.stack([last.get(*asked[i]) for i in mine], axis=1)
                    value, gradient, changes = _terms(rows_, y, w, before, np.array([asked[i][0] not in last for i in mine]))
                    for j, i in enumerate(mine):
                        yield i, np.append(value[j], gradient[j])
                    for j, change in changes:
                        yield len(asked) + mine[j], 2 * change[corner]

        found = summed(rows, parts)
        for i, (p, w) in enumerate(asked):
            d = len(w)
            v = found.get(i, np.zeros(1 + d)) * cost[p]
            corners[p] = found.get(len(asked) + i, np.zeros(d * (d + 1) // 2)) + (corners[p] if p in last else 0.0)
            last[p] = w
            value, gradient = w @ w / 2 + v[0], w + v[1:]
            if p in step and value > step[p][1] + 1e-12 * abs(step[p][1]):
                direction = step[p][0] / 2
                step[p] = direction, step[p][1]
                trial[p] = at[p] + direction
                del last[p]
                continue
            hessian = np.zeros((d, d))
            hessian[np.triu_indices(d)] = corners[p] * cost[p]
            hessian = hessian + np.triu(hessian, 1).T + np.eye(d)
            at[p] = w
            size = float(np.abs(gradient).max())
            if size <= tol * first.setdefault(p, max(size, 1e-300)):
                out[p] = w
                del trial[p]
                continue
            direction = -np.linalg.solve(hessian, gradient)
            step[p] = direction, value
            trial[p] = w + direction
    return {p: out.get(p, at[p]) for p in problems}


def choose(features: np.ndarray, weights: dict[int, np.ndarray]) -> np.ndarray:
    """The class with the largest margin for each row; of equal ones the smallest class."""
    labels = sorted(weights)
    margins = with_constant(features) @ np.stack([weights[c] for c in labels], axis=1)
    return np.array(labels)[margins.argmax(axis=1)]


def classes(rows: DataFrame, targets: list[str], fold: str, left_out: list[int | None]) -> list[Problem]:
    """One problem for each model (``left_out``: the fold that it isn't trained on), target and class among its rows."""
    long = rows.select(fold, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("label"))
                                                 for t in targets])).alias("s")).select(fold, "s.*")
    seen = long.filter("label is not null").distinct().collect()  # folds x targets x classes
    return sorted({Problem(m, r["target"], r["label"]) for r in seen for m, f in enumerate(left_out) if f is None or r[fold] != f})
