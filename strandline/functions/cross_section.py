"""Cross-sectional operators: over the entities of one date. Missing values are left out and stay missing; two values are needed."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .elementwise import EPS, finite
from .gauss import inverse_normal


class Section:
    """by: the columns that name a cross-section."""

    def __init__(self, by: tuple[str, ...] = ("t",)):
        self.by = by

    @property
    def every(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    def count(self, x: Column) -> Column:
        return F.count(x).over(self.every)

    def some(self, x: Column, out: Column, least: int = 2) -> Column:
        return F.when(x.isNotNull() & (self.count(x) >= least), finite(out))

    def average_rank(self, x: Column) -> Column:
        """From 0; equal values share the mean of their ranks. Defined where x is present."""
        present = Window.partitionBy(*self.by, x.isNull())
        ties = Window.partitionBy(*self.by, x)
        return F.rank().over(present.orderBy(x)) - 1 + (F.count(F.lit(1)).over(ties) - 1) / 2

    def quantiles(self, x: Column, low: float, high: float) -> Column:
        return F.percentile(x, F.array(F.lit(low), F.lit(high))).over(self.every)

    def clip(self, x: Column, low: float = 0.05, high: float = 0.95) -> Column:
        q = self.quantiles(x, low, high)
        return F.when(x.isNotNull(), F.least(F.greatest(x, q[0]), q[1]))

    def cs_rank(self, x: Column) -> Column:
        return self.some(x, (self.average_rank(x) + 0.5) / self.count(x))

    def cs_zscore(self, x: Column) -> Column:
        std = F.stddev_pop(x).over(self.every)
        return self.some(x, F.try_divide(x - F.avg(x).over(self.every), F.when(std > EPS, std)))

    def cs_demean(self, x: Column) -> Column:
        return self.some(x, x - F.avg(x).over(self.every))

    def cs_scale(self, x: Column) -> Column:
        total = F.sum(F.abs(x)).over(self.every)
        return self.some(x, F.try_divide(x, F.when(total > EPS, total)))

    def cs_normalize(self, x: Column) -> Column:
        least = F.min(x).over(self.every)
        return self.some(x, (x - least) / (F.max(x).over(self.every) - least + EPS))

    def cs_winsorize(self, x: Column) -> Column:
        return self.some(x, self.clip(x))

    def cs_truncate(self, x: Column) -> Column:
        q = self.quantiles(x, 0.05, 0.95)
        return self.some(x, F.when((x >= q[0]) & (x <= q[1]), x))

    def cs_quantile(self, x: Column) -> Column:
        return self.some(x, F.try_divide(self.average_rank(x), self.count(x) - 1))

    def cs_rank_gauss(self, x: Column) -> Column:
        return self.some(x, inverse_normal((self.average_rank(x) + 0.5) / self.count(x)))


NAMES = ("cs_rank", "cs_zscore", "cs_demean", "cs_scale", "cs_normalize", "cs_winsorize", "cs_truncate", "cs_quantile", "cs_rank_gauss")
