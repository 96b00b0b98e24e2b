"""Elastic-net linear regression from one aggregate (M4 on full vectors).

The objective of the linear model needs only the second moments of features
and label.  Two scans (means, then centred products; both partial + final
aggregates) give a (k + 1) × (k + 1) matrix, whatever the number of rows, and
coordinate descent on that matrix finds the coefficients on the driver.  The
iterative solver scans the data once per iteration instead.

Scaling follows MLlib's L-BFGS path: features and label are standardised by
sample deviations, the penalty is divided by the label's deviation, and a
constant feature has coefficient 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.learners import LINEAR_ELASTIC_NET, LINEAR_REG


@dataclass
class Moments:
    """Rows, means and the matrix of centred products; the label stands last."""
    n: int
    means: np.ndarray
    products: np.ndarray


@dataclass
class LinearFit:
    coefficients: np.ndarray
    intercept: float
    sweeps: int
    objective_history: list[float]


def moments(df: DataFrame, columns: Sequence[str], label: str = "label") -> Moments:
    """Means and centred products of ``columns`` and ``label``: two global aggregates."""
    names = [*columns, label]
    first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()
    means = np.array([first[1 + i] or 0.0 for i in range(len(names))], float)
    # Products of centred values: raw second moments would cancel digits.
    centred = df.select(*[(F.col(c).cast("double") - F.lit(float(m))).alias(f"_c{i}")
                          for i, (c, m) in enumerate(zip(names, means))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(*[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i, j in pairs]).first()
    products = np.zeros((len(names),) * 2)
    for (i, j), s in zip(pairs, sums):
        products[i, j] = products[j, i] = s or 0.0
    return Moments(int(first[0]), means, products)


def deviations(m: Moments) -> np.ndarray:
    """Sample deviations of the columns and, last, the label."""
    return np.sqrt(np.diag(m.products) / max(1, m.n - 1))


def objective(m: Moments, coefficients: np.ndarray, reg: float = LINEAR_REG, mix: float = LINEAR_ELASTIC_NET) -> float:
    """The penalised loss of coefficients in the columns' own units (intercept fitted)."""
    scale = np.where(deviations(m) > 0, deviations(m), 1.0)
    standard = m.products / max(1, m.n) / np.outer(scale, scale)
    w = np.asarray(coefficients) * scale[:-1] / scale[-1]
    a, b, total = standard[:-1, :-1], standard[:-1, -1], standard[-1, -1]
    return float((total - 2 * w @ b + w @ a @ w) / 2
                 + reg / scale[-1] * (mix * np.abs(w).sum() + (1 - mix) / 2 * w @ w))


def elastic_net(m: Moments, reg: float = LINEAR_REG, mix: float = LINEAR_ELASTIC_NET, sweeps: int = 10_000,
                tolerance: float = 1e-13) -> LinearFit:
    """Cyclic coordinate descent from 0 on the standardised moments."""
    k = len(m.means) - 1
    if m.n < 2:
        return LinearFit(np.zeros(k), float(m.means[-1]), 0, [])
    deviation = deviations(m)
    scale = np.where(deviation > 0, deviation, 1.0)
    standard = m.products / m.n / np.outer(scale, scale)
    a, b, total = standard[:k, :k], standard[:k, k], standard[k, k]
    l1 = reg * mix / scale[-1]
    l2 = reg * (1 - mix) / scale[-1]
    w = np.zeros(k)
    value = lambda: float((total - 2 * w @ b + w @ a @ w) / 2 + l1 * np.abs(w).sum() + l2 / 2 * w @ w)
    history, done = [value()], 0
    for done in range(1, sweeps + 1):
        moved = 0.0
        for j in range(k):
            if deviation[j] == 0:
                continue
            rho = b[j] - (a[j] @ w - a[j, j] * w[j])
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (a[j, j] + l2)
            moved, w[j] = max(moved, abs(new - w[j])), new
        history.append(value())
        if moved <= tolerance:
            break
    coefficients = w * scale[-1] / scale[:k]
    return LinearFit(coefficients, float(m.means[-1] - coefficients @ m.means[:k]), done, history)


def fit_linear_sums(df: DataFrame, columns: Sequence[str], label: str = "label", reg: float = LINEAR_REG,
                    mix: float = LINEAR_ELASTIC_NET) -> LinearFit:
    return elastic_net(moments(df, columns, label), reg, mix)


def predict_linear(df: DataFrame, columns: Sequence[str], fit: LinearFit, out: str = "prediction") -> DataFrame:
    """Score by a plain column expression."""
    total = F.lit(float(fit.intercept))
    for c, w in zip(columns, fit.coefficients):
        total = total + F.col(c) * F.lit(float(w))
    return df.withColumn(out, total)
