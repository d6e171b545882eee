"""Embedding texts as they come: a stream whose state is the cache of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.functions import text as T
from folioscan.operators import adapters
from folioscan.session import ship

DAYS = 7
#: To be set where such a stream is started with an available-now trigger: batches without data, which time
#: alone asks for, would never end.  State whose time is over then goes with the next data.
ENDS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def embedded(rows: DataFrame, name: str, make: Callable[[], adapters.Embed], least: int = 20, keep_ms: int = DAYS * 86_400_000) -> DataFrame:
    """(id, embedding, cache_key) of a stream's rows (id, text) whose stripped text has at least ``least`` characters.

    The key is of model and text, so equal texts share a vector: late and repeated rows get what is known,
    and a stream that starts again from its checkpoint asks for nothing that it knows.  A vector is kept for
    ``keep_ms`` of processing time: then its state goes, and a text that is met again is asked for anew."""
    ship(rows.sparkSession)
    text = T.strip("text")
    keyed = rows.where(F.length(text) >= least).select(F.col("id").cast("string").alias("id"), text.alias("text"), T.cache_key(name, text).alias("cache_key"))
    built: list[adapters.Embed] = []

    def vectors(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        known, at = state.get if state.exists else (None, 0)
        if known is not None and now - at >= keep_ms:
            known = None
        for frame in frames:
            if known is None:
                if not built:
                    built.append(make())
                v = [float(x) for x in built[0]([frame["text"].iloc[0]])[0]]
                size = sum(x * x for x in v) ** 0.5 or 1.0
                known, at = [x / size for x in v], now
                state.update((known, at))
            yield pd.DataFrame({"id": frame["id"], "embedding": [list(known)] * len(frame), "cache_key": key[0]})
        state.setTimeoutDuration(max(1, at + keep_ms - now))

    return keyed.groupBy("cache_key").applyInPandasWithState(vectors, "id string, embedding array<float>, cache_key string", "v array<double>, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
