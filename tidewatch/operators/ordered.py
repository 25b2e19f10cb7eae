"""Folds over ordered groups whose tasks hold a batch of rows, however long a group is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: each(key, parts) gets a group's rows in order, as frames of at most a batch, and yields frames of results.
Each = Callable[[object, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _runs(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """The batches, cut where the key changes."""
    for batch in batches:
        codes = pd.factorize(batch[key], use_na_sentinel=False)[0]
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                name = batch[key].iloc[a]
                yield (None if pd.isna(name) else name), batch.iloc[a:b]


def fold(rows: DataFrame, key: str, order: tuple[str, ...], each: Each, schema: str) -> DataFrame:
    """each() over the rows of each key, sorted by Spark, which spills what doesn't fit; null is a key. A key is one task's."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, own in groupby(_runs(batches, key), key=lambda r: r[0]):
            yield from each(name, (part for _, part in own))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(task, schema)


def fold_all(rows: DataFrame, key: str, order: tuple[str, ...], sequence: Callable[[Iterator[tuple[object, Iterator[pd.DataFrame]]]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """One sequence over all keys in their order, in one task: sequence() gets each key with its parts."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from sequence((name, (part for _, part in own)) for name, own in groupby(_runs(batches, key), key=lambda r: r[0]))

    return rows.repartition(1).sortWithinPartitions(key, *order).mapInPandas(task, schema)
