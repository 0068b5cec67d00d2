"""Two-sided normal tail. Spark SQL has no erf, so this is a Python function on Arrow batches, without a loop over values."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

# Below this the series of the error function is used, above it the continued fraction of its complement.
_CUT, _SERIES_TERMS, _FRACTION_DEPTH = 2.0, 45, 90


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers from 0 up; NaN stays NaN."""
    near = np.minimum(x, _CUT)
    term = total = near
    for n in range(1, _SERIES_TERMS):
        term = term * (2.0 * near * near / (2 * n + 1))
        total = total + term
    series = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(x, _CUT)
    fraction = far
    for n in range(_FRACTION_DEPTH, 0, -1):
        fraction = far + (n / 2.0) / fraction
    return np.where(x < _CUT, series, np.exp(-far * far) / (fraction * math.sqrt(math.pi)))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(erfc(np.abs(z.to_numpy(dtype="float64", na_value=np.nan)) / math.sqrt(2.0))).where(z.notna().to_numpy())
