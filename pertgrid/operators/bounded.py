"""Cross-fitted parameters of nonlinear predictions within bounds, by bracketed searches of all folds at once.

A step lays a small grid into every fold's bracket and makes one aggregate of the rows: per fold the squared errors at the
points of all folds.  A fold's training loss at its own points is the sum over the other folds.  The bracket then closes around the
best point, to half the grid's spacing or less.  No step depends on the number of rows but that aggregate.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a grid along each parameter, by the number of parameters.
POINTS = {1: 9, 2: 5}


def bounded_fit(rows: DataFrame, fold: str, outcome: str, predicted: Callable[..., Column], bounds: list[tuple[float, float]], tolerance: float = 1e-4) -> DataFrame:
    """fold, parameters, loss: for each fold the parameters (one or two) with the least squared error of the other folds' rows.

    ``predicted`` makes a column of literals, one a parameter.  Rows whose outcome or prediction is null or NaN have no part; with no
    rows in other folds the lower bounds are returned, with loss 0.  The loss must have one minimum within the bounds along each
    parameter for the search to find it; of equal points the smaller is taken.  Parameters never leave the bounds.
    """
    count = POINTS[len(bounds)]
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]  # a row per fold
    windows = {h: [list(b) for b in bounds] for h in folds}
    best: dict[object, tuple[float, tuple[float, ...]]] = {}
    while folds:
        grids = {h: list(itertools.product(*[[low + (high - low) * j / (count - 1) for j in range(count)] for low, high in windows[h]])) for h in folds}
        flat = [(h, point) for h in folds for point in grids[h]]

        def error(point: tuple[float, ...]) -> Column:
            e = predicted(*[F.lit(float(x)) for x in point]) - F.col(outcome)
            return F.coalesce(F.sum(F.nanvl(e * e, F.lit(0.0))), F.lit(0.0))

        sums = rows.groupBy(fold).agg(F.array(*[error(point) for _, point in flat]).alias("errors")).collect()  # a row per fold
        for h in folds:
            losses = [(sum(r.errors[k] for r in sums if r[0] != h), point) for k, (own, point) in enumerate(flat) if own == h]
            best[h] = min([*losses, *([best[h]] if h in best else [])])
            for j, (low, high) in enumerate(bounds):
                step = (windows[h][j][1] - windows[h][j][0]) / (count - 1)
                windows[h][j] = [max(low, best[h][1][j] - step), min(high, best[h][1][j] + step)]
        if all(high - low < tolerance for window in windows.values() for low, high in window):
            break
    kind = rows.schema[fold].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(h, list(best[h][1]), float(best[h][0])) for h in folds], f"{fold} {kind}, parameters array<double>, loss double")
