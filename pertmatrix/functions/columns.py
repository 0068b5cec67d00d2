"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LN2_SQ = math.log(2.0) ** 2


def rint(x: Column) -> Column:
    """Round half to even."""
    return F.bround(x) + F.lit(0.0)


def finite_or_zero(x: Column) -> Column:
    """NaN, infinities and NULL become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def per_library(value: Column, libsize: Column, target: float) -> Column:
    return value / libsize * F.lit(float(target))


def log2_fold_change(mean_pert: Column, mean_ctrl: Column, pseudocount: float = 1.0) -> Column:
    return F.log2((mean_pert + pseudocount) / (mean_ctrl + pseudocount))


def log2_fold_change_var(
    mean_p: Column, var_p: Column, n_p: Column, mean_c: Column, var_c: Column, n_c: Column,
    pseudocount: float = 1.0,
) -> Column:
    """Delta-method variance of :func:`log2_fold_change`."""
    pert = var_p / n_p / ((mean_p + pseudocount) * (mean_p + pseudocount))
    ctrl = var_c / n_c / ((mean_c + pseudocount) * (mean_c + pseudocount))
    return (pert + ctrl) / F.lit(LN2_SQ)


def shrink_positive_part(fc: Column, var: Column) -> Column:
    """fc * max(0, 1 - var / fc^2), gene by gene; 0 stays 0."""
    keep = F.lit(1.0) - var / F.greatest(fc * fc, F.lit(1e-12))
    return F.when(fc == 0, F.lit(0.0)).otherwise(fc * F.greatest(F.lit(0.0), F.least(F.lit(1.0), keep)))


def shift_clip_floor(value: Column, delta: Column, floor: Column) -> Column:
    """value + delta, clipped at 0, with results below the assay floor set to 0."""
    shifted = F.greatest(value + delta, F.lit(0.0))
    return F.when(shifted < floor, F.lit(0.0)).otherwise(shifted)


def pop_var(total_sq: Column, total: Column, n: Column) -> Column:
    """Population variance from sums, never negative."""
    mean = total / n
    return F.greatest(total_sq / n - mean * mean, F.lit(0.0))


def is_whole(x: Column) -> Column:
    """Equal to its rounding within the usual closeness test (rtol 1e-5, atol 1e-8)."""
    near = F.bround(x)
    return F.abs(x - near) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(near)
