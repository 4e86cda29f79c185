"""Batched inference with an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def predict_batches(rows: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], pd.Series]], out: str, kind: str) -> DataFrame:
    """``rows`` with ``out``: what the loaded model says of ``column``, batch by batch.

    ``load`` runs once in each task and returns the model, so that nothing large is sent
    with the plan. Null inputs reach the model as None; a batch must keep its length.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            said = model(b[column])
            if len(said) != len(b):
                raise ValueError("the model must answer every row")
            yield b.assign(**{out: said})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, _parse_datatype_string(kind))]))
