"""Hashes that wrap around at 64 bits, which Spark's checked arithmetic can't express; vectorised by Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: regions are spread over this many slots.
SLOTS = 128


def hash_u64(x: Column) -> Column:
    """splitmix64 of a long (as its 64 bits), as a long."""

    @F.pandas_udf("long")
    def mixed(v: pd.Series) -> pd.Series:
        x = v.to_numpy(np.int64).view(np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return pd.Series((x ^ x >> np.uint64(31)).view(np.int64))

    return mixed(x)


def slot(region_id: Column) -> Column:
    return hash_u64(region_id).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
