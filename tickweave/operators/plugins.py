"""Entry points for functions of the user: a factor computed in Python, and an encoder of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.expr import Panel


def user_factor(df: DataFrame, compute: Callable[[pd.DataFrame], pd.Series], panel: Panel = Panel(), name: str = "factor") -> DataFrame:
    """``df`` with a column of what ``compute`` returns for each panel, which it gets whole and in order (one day of one
    code; that is what a task holds). The result must have a value per row; infinite values and NaN become null. Panels
    are independent, so a function sees no other's rows; rows without a panel key form panels of their own."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(panel.order), kind="stable", ignore_index=True)
        x = pd.Series(np.asarray(compute(pdf.copy()), float))
        if len(x) != len(pdf):
            raise ValueError(f"the factor has {len(x)} values for {len(pdf)} rows")
        return pdf.assign(**{name: x.replace([np.inf, -np.inf], np.nan)})

    out = df.groupBy(*panel.by).applyInPandas(run, f"{kinds}, `{name}` double")
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def encoded(df: DataFrame, ident: Column, text: Column, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """(id, vector) of every row by an encoder that ``make`` builds once in each task: a list of texts to a matrix of as
    many rows. Null texts are empty ones; vectors are of unit length, zero ones stay zero."""
    src = df.select(ident.alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                encode = encode or make()
                m = np.asarray(encode(part["text"].tolist()), float)
                if m.shape[0] != len(part):
                    raise ValueError(f"the encoder gave {m.shape[0]} vectors for {len(part)} texts")
                size = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"id": part["id"], "vector": list(m / np.where(size > 0, size, 1.0))})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, vector array<double>")
