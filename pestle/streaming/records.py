"""Record streams: distinct rows, running means and neighbour search against a fixed set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pestle.operators.similarity import merge_neighbours, nearest


def distinct_stream(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key; with a watermark the state of old keys is let go."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def latest_means(stream: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """``key, order, mean`` of the last ``k`` values of the key, after each record; state: ``k`` values a key."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for frame in frames:
            rows = []
            for o, v in frame.sort_values(order)[[order, value]].itertuples(index=False):
                last = [*last, float(v)][-k:]
                rows.append((group[0], o, sum(last) / len(last)))
            yield pd.DataFrame(rows, columns=[key, order, "mean"])
        state.update((last,))

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, mean double"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, by: list[str]) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def nearest_of_stream(needles: DataFrame, path: str, k: int):
    """A ``foreachBatch`` function that keeps the best ``k`` of a streamed haystack in ``path/<batch>``."""

    def batch(haystack: DataFrame, number: int) -> None:
        best = nearest(needles, haystack, k, same_id=True)
        if number:
            before = needles.sparkSession.read.parquet(f"{path}/{number - 1}")
            best = merge_neighbours([before.select("needle", "neighbour", "distance"), best.select("needle", "neighbour", "distance")], k)
        best.write.mode("overwrite").parquet(f"{path}/{number}")

    return batch
