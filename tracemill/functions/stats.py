"""Interval and agreement statistics as Column expressions; every input and output stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5% point of the normal distribution (fixed value).
Z95 = 1.959963984540054


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def round4(x: Column) -> Column:
    """Four decimals, half to even, as all reported rates are rounded."""
    return F.bround(x, 4)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct<lo, hi>: Wilson score interval of k in n, within [0, 1]; null if n is 0 or null."""
    k, n, z1 = _d(k), _d(n), _d(z)
    p = F.try_divide(k, n)
    denom = 1 + F.try_divide(z1 * z1, n)
    centre = (p + F.try_divide(z1 * z1, 2 * n)) / denom
    half = z1 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z1 * z1, 4 * n * n)) / denom
    interval = F.struct(F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi"))
    return F.when(n > 0, interval)


def rate(k: Column, n: Column) -> Column:
    """struct<k, n, rate, lo, hi>, rounded; rate and bounds are null if n is 0."""
    ci = wilson(k, n)
    return F.struct(
        k.cast("long").alias("k"), n.cast("long").alias("n"), round4(F.try_divide(_d(k), _d(n))).alias("rate"),
        round4(ci["lo"]).alias("lo"), round4(ci["hi"]).alias("hi"),
    )


def kappa(po: Column, pe: Column) -> Column:
    """Cohen's kappa from observed and chance agreement; null if chance agreement is 1."""
    return F.when(pe < 1.0, (po - pe) / (1 - pe))


def kappa_interval(po: Column, pe: Column, n: Column, z: float = Z95) -> Column:
    """struct<lo, hi>: large-sample interval of kappa, within [-1, 1]."""
    k, n, z1 = kappa(po, pe), _d(n), _d(z)
    half = z1 * F.sqrt(F.try_divide(po * (1 - po), n * (1 - pe) * (1 - pe)))
    return F.when((n > 0) & (pe < 1.0), F.struct(F.greatest(F.lit(-1.0), k - half).alias("lo"), F.least(F.lit(1.0), k + half).alias("hi")))


def majority_of_3(top: Column, trials: Column, tied: Column) -> Column:
    """Chance that most of 3 trials, drawn without replacement, give the majority label; null under 5 trials or if tied."""
    b, n = _d(top), _d(trials)
    pairs = b * (b - 1) / 2 * (n - b)
    triples = b * (b - 1) * (b - 2) / 6
    return F.when((trials >= 5) & ~tied, F.try_divide(pairs + triples, n * (n - 1) * (n - 2) / 6))


def majority_of(k: int, top: Column, trials: Column, tied: Column) -> Column:
    """The same for any k: sums of binomial coefficients as running products."""
    b, n = _d(top), _d(trials)

    def choose(m: Column, r: int) -> Column:
        out = F.lit(1.0)
        for i in range(r):
            out = out * (m - i) / (i + 1)
        return F.when(m >= r, out).otherwise(F.lit(0.0))

    hits = F.lit(0.0)
    for x in range(k // 2 + 1, k + 1):
        hits = hits + choose(b, x) * choose(n - b, k - x)
    return F.when((trials >= k + 2) & ~tied, F.try_divide(hits, choose(n, k)))


def band(value: Column, good: float, warn: float) -> Column:
    """good, warning or critical."""
    return F.when(value <= good, "good").when(value <= warn, "warning").otherwise("critical")


def worst(*levels: Column) -> Column:
    """The most severe of good, warning and critical; nulls don't count, none gives good."""
    rank = F.greatest(F.lit(0), *[F.when(x == "critical", 2).when(x == "warning", 1).otherwise(0) for x in levels])
    return F.element_at(F.array(F.lit("good"), F.lit("warning"), F.lit("critical")), rank + 1)
