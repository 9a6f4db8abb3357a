"""Merge operators: associative folds of a key's operands, oldest first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concatenate(value: str = "value", seq: str = "seq") -> Column:
    """The default: binary operands one after another, old to new."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def overwrite(value: str = "value", seq: str = "seq") -> Column:
    return F.max_by(value, seq)


def custom(entries: DataFrame, fold: Callable[[list[bytes]], bytes | None]) -> DataFrame:
    """(key, seq, value) by any associative fold; a fold that gives None removes the key. Operands of a key fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold([bytes(v) for v in pdf.sort_values("seq")["value"]])
        return pd.DataFrame([] if out is None else [(pdf["key"].iat[0], out)], columns=["key", "value"])

    return entries.groupBy("key").applyInPandas(run, f"key {dict(entries.dtypes)['key']}, value binary")
