"""Rolling operators: over the last n rows of an entity on a dense grid of dates.

A result needs n present values in a row, but for delay and delta. t: the column with the number of the date on the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .elementwise import EPS, both, finite


class Series:
    def __init__(self, entity: str = "stock", t: str = "t"):
        self.entity, self.t = entity, t

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.t)

    def last(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    def full(self, x: Column, n: int, out: Column) -> Column:
        return F.when(F.count(x).over(self.last(n)) == n, finite(out))

    def _mean(self, x, n):
        return F.avg(x).over(self.last(n))

    def _std(self, x, n):
        return F.stddev_pop(x).over(self.last(n))

    def _slope(self, x, n):
        return F.regr_slope(x, F.col(self.t).cast("double")).over(self.last(n))

    def _extremes(self, x, n):
        return F.min(x).over(self.last(n)), F.max(x).over(self.last(n))

    def ts_mean(self, x, n):
        return self.full(x, n, self._mean(x, n))

    def ts_std(self, x, n):
        return self.full(x, n, self._std(x, n))

    def ts_max(self, x, n):
        return self.full(x, n, self._extremes(x, n)[1])

    def ts_min(self, x, n):
        return self.full(x, n, self._extremes(x, n)[0])

    def ts_sum(self, x, n):
        return self.full(x, n, F.sum(x).over(self.last(n)))

    def ts_rank(self, x, n):
        a = F.collect_list(x).over(self.last(n))
        less, equal = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
        return self.full(x, n, (less + equal * 0.5) / n)

    def ts_delay(self, x, n):
        return F.lag(x, n).over(self.order)

    def ts_delta(self, x, n):
        return finite(x - F.lag(x, n).over(self.order))

    def ts_argmax(self, x, n):
        """Rows from the start of the window to the latest largest value."""
        top = F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(self.t).alias("t")))).over(self.last(n))
        return self.full(x, n, (top["t"] - F.col(self.t) + (n - 1)).cast("double"))

    def ts_argmin(self, x, n):
        low = F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col(self.t)).alias("t")))).over(self.last(n))
        return self.full(x, n, (-low["t"] - F.col(self.t) + (n - 1)).cast("double"))

    def ts_wma(self, x, n):
        """Weights 1 to n, the newest heaviest. Dates are counted from the entity's own row, so that the products stay small."""
        t = F.col(self.t)
        return self.full(x, n, (F.sum(x * t).over(self.last(n)) - (t - n) * F.sum(x).over(self.last(n))) / (n * (n + 1) / 2))

    def ts_ema(self, x, n):
        """Exponential mean since the last missing value, from n values on; needs the column of ema_run().

        Values so old that their weight is under 1e-18 are left out, so the work on a row doesn't grow with the history.
        """
        alpha = 2.0 / (n + 1)
        reach = math.ceil(18 * math.log(10) / -math.log(1 - alpha))
        run = F.sum(x.isNull().cast("int")).over(self.order)
        return run, lambda r: self._ema(x, n, r, alpha, reach)

    def _ema(self, x, n, run, alpha, reach):
        w = Window.partitionBy(self.entity, run).orderBy(self.t)
        a = F.collect_list(x).over(w.rowsBetween(-reach, 0))
        fold = F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), a[0], lambda e, v: v * alpha + e * (1 - alpha))
        return F.when(x.isNotNull() & (F.size(a) >= n), finite(fold))

    def ts_slope(self, x, n):
        return self.full(x, n, self._slope(x, n))

    def ts_residual(self, x, n):
        return self.full(x, n, x - self._mean(x, n) - self._slope(x, n) * ((n - 1) / 2))

    def ts_zscore(self, x, n):
        std = self._std(x, n)
        return self.full(x, n, F.try_divide(x - self._mean(x, n), F.when(std > EPS, std)))

    def ts_position(self, x, n):
        low, high = self._extremes(x, n)
        return self.full(x, n, (x - low) / (high - low + EPS))

    def ts_range(self, x, n):
        low, high = self._extremes(x, n)
        return self.full(x, n, high - low)

    # of two series, over rows where both are present

    def _joint(self, x, y):
        ok = both(x, y)
        return F.when(ok, x), F.when(ok, y)

    def ts_cov(self, x, y, n):
        x, y = self._joint(x, y)
        return self.full(x, n, F.covar_pop(x, y).over(self.last(n)))

    def ts_corr(self, x, y, n):
        x, y = self._joint(x, y)
        sx, sy = self._std(x, n), self._std(y, n)
        return self.full(x, n, F.try_divide(F.covar_pop(x, y).over(self.last(n)), F.when((sx > EPS) & (sy > EPS), sx * sy)))

    def _beta(self, x, y, n):
        var = F.var_pop(y).over(self.last(n))
        return F.try_divide(F.covar_pop(x, y).over(self.last(n)), F.when(var > EPS, var))

    def ts_beta(self, x, y, n):
        x, y = self._joint(x, y)
        return self.full(x, n, self._beta(x, y, n))

    def ts_orth(self, x, y, n):
        x, y = self._joint(x, y)
        return self.full(x, n, x - self._mean(x, n) - self._beta(x, y, n) * (y - self._mean(y, n)))


UNARY = ("ts_mean", "ts_std", "ts_max", "ts_min", "ts_rank", "ts_delay", "ts_delta", "ts_sum", "ts_argmax", "ts_argmin", "ts_wma", "ts_ema", "ts_slope", "ts_residual", "ts_zscore", "ts_position", "ts_range")
BINARY = ("ts_corr", "ts_cov", "ts_beta", "ts_orth")
# fixed values: windows of the rolling operators
WINDOWS = (5, 10, 20, 40, 60)
