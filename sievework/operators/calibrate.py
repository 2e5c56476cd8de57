"""Temperature scaling: one number that logits are divided by, so that scores are probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.cluster import settle
from sievework.functions.local import fixed_table

EDGE = 1e-7


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(p / (1 - p))


def temperature(rows: DataFrame, rounds: int = 100, near: float = 1e-9) -> DataFrame:
    """One row for logits z and labels y (0/1): n, temperature, loss_before (at 1), loss_after, gradient, rounds and settled.

    The mean loss is convex in b = 1 / temperature. Newton's step needs the sums of gradient and curvature, one aggregation a round over the
    distinct logits and labels with their counts; a step out of the known bracket around the optimum is replaced by halving the bracket. It is settled when
    the gradient by b is at most `near`. Rows with a null go. If the loss doesn't fall with any b above 0 (labels that scores say nothing of), there is
    no temperature (null) and the loss is that of b = 0; the same for no rows. If labels are separable, the loss
    falls for ever, and the last b of `rounds` is given, not settled.
    """
    cells = settle(rows.where("z is not null and y is not null").groupBy(F.col("z").cast("double").alias("z"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n")))

    def look(b: float) -> tuple[float, float, float, int]:
        """gradient, curvature and mean loss at b, and the number of rows."""
        x = F.col("z") * b
        p = 1 / (1 + F.exp(-x))
        loss = F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(F.exp(-F.abs(x)))
        mean = lambda c: F.coalesce(F.sum(c * F.col("n")) / F.sum("n"), F.lit(0.0))
        return cells.agg(mean((p - F.col("y")) * F.col("z")), mean(p * (1 - p) * F.col("z") * F.col("z")), mean(loss), F.coalesce(F.sum("n"), F.lit(0))).first()

    low, high, b, used = 0.0, math.inf, 1.0, 0
    g, _, flat, n = look(0.0)
    schema = "n long, temperature double, loss_before double, loss_after double, gradient double, rounds int, settled boolean"
    if g >= 0:
        return fixed_table(rows.sparkSession, [(n, None, look(1.0)[2], flat, g, 0, True)], schema)
    before = None
    while True:
        g, h, loss, _ = look(b)
        used, before = used + 1, loss if before is None else before
        if abs(g) <= near or used == rounds:
            break
        low, high = (b, high) if g < 0 else (low, b)
        step = b - g / h if h > 0 else math.inf
        b = step if low < step < high and step < 1e12 else (low + high) / 2 if high < math.inf else 2 * b
    return fixed_table(rows.sparkSession, [(n, 1 / b, before, loss, g, used, abs(g) <= near)], schema)
