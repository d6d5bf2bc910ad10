"""Numpy work on whole groups, many groups per batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: str, work: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Run ``work`` on each group, given as a dict of arrays sorted by ``order``.

    Rows arrive as sorted batches that hold many groups, so small groups cost no
    batch of their own; only a group that is still open is carried to the next batch.
    The caller makes sure that a group fits a task.
    """
    columns = list(df.columns)

    def run(batches):
        open_rows: list[dict] = []
        open_key = None

        def finish(parts: list[dict]) -> dict | None:
            whole = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in columns}
            return work(whole)

        for pdf in batches:
            data = {c: pdf[c].to_numpy() for c in columns}
            n = len(pdf)
            if n == 0:
                continue
            change = np.zeros(n - 1, dtype=bool)
            for k in keys:
                change |= data[k][1:] != data[k][:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
            done = []
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(data[k][a] for k in keys)
                part = {c: data[c][a:b] for c in columns}
                if key != open_key and open_rows:
                    done.append(finish(open_rows))
                    open_rows = []
                open_key = key
                open_rows.append(part)
            done = [d for d in done if d is not None]
            if done:
                yield pd.DataFrame({c: np.concatenate([d[c] for d in done]) for c in done[0]})
        if open_rows:
            last = finish(open_rows)
            if last is not None:
                yield pd.DataFrame(last)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
