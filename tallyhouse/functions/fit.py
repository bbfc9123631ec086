"""Least squares from aggregated moments."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(y: Column, x: Column) -> list[Column]:
    """Aggregates `_n, _sxy, _sxx, _syy` and the two means of a point set.

    Every one merges partial results, so a fit never gathers its points.
    """
    x, y = x.cast("double"), y.cast("double")
    return [
        F.count(y).alias("_n"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.avg(x).alias("_mean_x"),
        F.avg(y).alias("_mean_y"),
    ]


MOMENT_COLUMNS = ("_n", "_sxy", "_sxx", "_syy", "_mean_x", "_mean_y")


def slope() -> Column:
    """0.0 when all x are equal."""
    return F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.lit(0.0))


def intercept() -> Column:
    return F.col("_mean_y") - slope() * F.col("_mean_x")


def r2() -> Column:
    """Goodness of fit; with a constant x or y it is 1.0 for two points, else 0.0."""
    spread = (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    fitted = F.col("_sxy") * F.col("_sxy") / (F.col("_sxx") * F.col("_syy"))
    return F.when(spread, fitted).otherwise(F.when(F.col("_n") == 2, 1.0).otherwise(0.0))
