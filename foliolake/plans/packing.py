"""Packs vectors the way an external store delivers them; only the named queries need it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack_floats(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes())
