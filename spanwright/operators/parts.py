"""Order-bound kernels over many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_parts(rows: DataFrame, part: str, order: list[str], columns: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` gets frames of whole groups of ``part``, many in each, sorted by ``part`` and
    ``order``, with ``columns`` besides ``part``. Groups of a few rows cost no frame of their
    own; a task holds an Arrow batch and at most one unfinished group."""
    ready = rows.repartition(F.col(part)).sortWithinPartitions(part, *order).select(part, *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            names = batch[part].to_numpy()
            cut = int((names != names[-1]).sum())  # sorted, so the last group is the tail
            if cut or (held and held[-1][part].iloc[-1] != names[0]):
                done = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
                if len(done):
                    yield kernel(done)
                held = [batch.iloc[cut:]]
            else:
                held.append(batch)
        if held:
            yield kernel(pd.concat(held, ignore_index=True))

    return ready.mapInPandas(run, schema)
