"""Work inside groups that are small beside the data (documents, pages, cells): whole groups handed to numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows that begin another group than the row before."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for key in keys:
        values = rows[key].to_numpy()
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def by_groups(items: DataFrame, keys: list[str], order: list[str], handle, schema: str) -> DataFrame:
    """``handle(rows, cuts)`` over runs of whole groups, each sorted by ``order`` (nulls first); group i is rows cuts[i] to cuts[i + 1].

    A group that fills many batches is put together once, when its end is seen, so time is linear in its rows. ``keys`` aren't null.
    """

    def whole(held: list[pd.DataFrame]) -> pd.DataFrame:
        return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and not len(_starts(pd.concat([held[-1][keys].iloc[-1:], batch[keys].iloc[[0, -1]]]), keys)):
                held.append(batch)  # the same group goes on
                continue
            rows = whole([*held, batch])
            cuts = [0, *_starts(rows, keys).tolist()]
            if len(cuts) > 1:
                yield handle(rows.iloc[: cuts[-1]], cuts)
            held = [rows.iloc[cuts[-1] :]]
        if held:
            rows = whole(held)
            yield handle(rows, [0, len(rows)])

    # By a hash of our own: Spark would drop a shuffle by keys that a join or union below has been dealt by, and then may
    # split that one (skewed joins) or coalesce its sides apart (unions), which tears groups.
    return items.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def in_order(items: DataFrame, key: str, handle, schema: str) -> DataFrame:
    """``handle(batch)``, Arrow to Arrow, over batches of whole groups of ``key`` of items that lie in its order, as a window by it leaves them.

    Nothing is dealt or sorted anew; items that aren't in the order of ``key`` in their partition are an error. A group that fills many
    batches is put together once.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            if (keys[1:] < keys[:-1]).any() or (last is not None and keys[0] < last):
                raise ValueError(f"rows aren't in the order of {key}")
            start = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if held and (start or keys[0] != last):
                yield handle(pa.concat_batches([*held, batch.slice(0, start)]))
                held = []
            elif start:
                yield handle(batch.slice(0, start))
            held.append(batch.slice(start))
            last = keys[-1]
        if held:
            yield handle(pa.concat_batches(held))

    return items.mapInArrow(run, schema)
