"""NULL-safe statistics as aggregate expressions."""

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson r; NULL for a constant series, where ANSI `corr` would raise."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def determination(y: Column, yhat: Column) -> Column:
    """1 - SSE/SST; NULL when the observations do not vary."""
    both = y.isNotNull() & yhat.isNotNull()
    a, e = F.when(both, y), F.when(both, y - yhat)
    return 1.0 - F.sum(e * e) / F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0))


def error_metrics(y: Column, yhat: Column) -> list[Column]:
    """ME, RMSE, MAE, number of points and r of one group of complete pairs."""
    e = yhat - y
    return [
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.count(e).alias("n"),
        pearson(y, yhat).alias("r"),
    ]


def safe_log(x: Column) -> Column:
    """ln(x); NULL for x <= 0, so that the row counts as incomplete."""
    return F.when(x > 0, F.log(x))


def null_skipping_sum(*cols: Column) -> Column:
    total = F.coalesce(cols[0], F.lit(0.0))
    for c in cols[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    return total
