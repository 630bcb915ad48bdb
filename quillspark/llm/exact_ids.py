"""Document ids through pandas without loss.

A column of longs with a null in it reaches pandas as float64, which holds integers exactly only up to 2**53.
So ids travel as a number that is never null beside a flag, and come back as nullable integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sent(doc_id: str = "doc_id") -> list[Column]:
    """The id, 0 where it is null, and whether it is null."""
    x = F.col(doc_id).cast("long")
    return [F.coalesce(x, F.lit(0).cast("long")).alias("doc_id"), x.isNull().alias("no_id")]


def received(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(batch["doc_id"].to_numpy(dtype="int64"), batch["no_id"].to_numpy(dtype=bool))


def listed(batch: pd.DataFrame) -> list[int | None]:
    return [None if no else i for i, no in zip(batch["doc_id"].tolist(), batch["no_id"].tolist())]


def column(ids: list[int | None]) -> pd.arrays.IntegerArray:
    none = [i is None for i in ids]
    return pd.arrays.IntegerArray(pd.Series([0 if i is None else i for i in ids], dtype="int64").to_numpy(), pd.Series(none, dtype=bool).to_numpy())
