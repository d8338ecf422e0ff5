"""Small dense solves inside tasks; the sums that feed them are ordinary aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Least-squares coefficients from the flattened normal matrix and right-hand side."""
    out = []
    for a, b in zip(xtx, xty):
        if a is None or b is None or any(v is None for v in a):
            out.append(None)
            continue
        k = len(b)
        m = np.asarray(a, dtype=float).reshape(k, k)
        d = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        sol = np.linalg.lstsq(m / np.outer(d, d), np.asarray(b, dtype=float) / d, rcond=1e-12)[0]
        out.append(sol / d)
    return pd.Series(out)


def normal_sums(basis: list[Column], y: Column, weight: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Aggregates of the upper triangle of the normal matrix (row by row) and of the right-hand
    side; ``symmetric`` puts them back together."""
    w = F.lit(1.0) if weight is None else weight
    up = [F.sum(a * b * w).alias(f"_a{i}_{j}") for i, a in enumerate(basis) for j, b in enumerate(basis) if j >= i]
    return up, [F.sum(a * y * w).alias(f"_b{i}") for i, a in enumerate(basis)]


def symmetric(k: int) -> tuple[Column, Column]:
    """Array columns of the full matrix and the right-hand side after ``normal_sums``."""
    full = [F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return F.array(*full), F.array(*[F.col(f"_b{i}") for i in range(k)])


def band_solver() -> Callable[..., np.ndarray]:
    """``solve_band``, made here so that tasks get it by value and need not import this package."""

    def solve_band(band: np.ndarray, rhs: np.ndarray, rel: float = 1e-13) -> np.ndarray:
        """Solve A x = rhs for a positive semi-definite A given by ``band[i, o] = A[i, i + o]``.

        Elimination along the band, so memory and time grow with its length. A row whose pivot falls to
        ``rel`` of the largest diagonal element depends on those before it and gets 0; for normal
        equations any such solution fits equally well.
        """
        a, x = band.tolist(), rhs.tolist()
        n, width = len(x), band.shape[1]
        low = max(float(band[:, 0].max(initial=0.0)) * rel, 0.0)
        for i, row in enumerate(a):
            if row[0] <= low:
                a[i] = None
                continue
            for o in range(1, min(width, n - i)):
                f = row[o] / row[0]
                if f:
                    below = a[i + o]
                    for j in range(o, width):
                        below[j - o] -= f * row[j]
                    x[i + o] -= f * x[i]
        for i in range(n - 1, -1, -1):
            row = a[i]
            if row is None:
                x[i] = 0.0
            else:
                x[i] = (x[i] - sum(row[o] * x[i + o] for o in range(1, min(width, n - i)))) / row[0]
        return np.array(x)

    return solve_band
