"""IEEE half-precision bits of single-precision values and back (a legacy vector format)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.IntegerType())
def to_half(x: pd.Series) -> pd.Series:
    """Bits 0 to 65535 of the nearest half."""
    return pd.Series(x.to_numpy(np.float32).astype(np.float16).view(np.uint16).astype(np.int32))


@F.pandas_udf(T.FloatType())
def from_half(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.int64).astype(np.uint16).view(np.float16).astype(np.float32))
