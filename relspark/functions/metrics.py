"""Agreement and ranking metrics as expressions over counts, so that point estimates and resamples share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def kappa_of(agreement: Column, chance: Column) -> Column:
    """(po - pe) / (1 - pe); where pe is 1 the agreement decides between 1 and 0."""
    flat = F.when(F.abs(agreement - 1) <= 1e-9, 1.0).otherwise(0.0)
    return F.when(agreement.isNull(), None).when(1 - chance == 0, flat).otherwise(F.try_divide(agreement - chance, 1 - chance))


def cohen_kappa(n: Column, a: Column, b: Column, both: Column) -> Column:
    """Of two binary raters: items, positives of each, positives of both."""
    n, a, b, both = (x.cast("double") for x in (n, a, b, both))
    agreement = F.try_divide(both + (n - a - b + both), n)
    return kappa_of(agreement, F.try_divide(a * b + (n - a) * (n - b), n * n))


def observed_agreement(n: Column, a: Column, b: Column, both: Column) -> Column:
    return ratio(n - a - b + both + both, n)


def zero_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return zero_ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return zero_ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return zero_ratio(2 * tp, 2 * tp + fp + fn)


def gain(relevant: Column, rank: Column, k: int) -> Column:
    """(2^rel - 1) / log2(rank + 1) within the first k ranks, else 0."""
    return F.when(rank <= k, (F.pow(F.lit(2.0), relevant.cast("int")) - 1) / F.log2(rank + 1)).otherwise(0.0)


def ideal_gain(relevant: Column, k: int) -> Column:
    """The DCG of min(relevant, k) relevant items at the top."""
    top = F.least(relevant.cast("int"), F.lit(k))
    return F.when(top <= 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
