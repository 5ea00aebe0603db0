"""The rate limiter: at most `most` accepted requests of a key within `seconds` before each; refused ones do not count.

Batch: a pass over the requests of each key in order of time, that carries the accepted times within the window and
nothing else. Streaming: the same times as state, with a timeout that drops keys that have been quiet for a window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(requests: DataFrame, key: str, time: str, request_id: str, seconds: float, most: int) -> DataFrame:
    """(key, request_id, time, accepted). Requests of one time are taken in the order of their ids; rows without a key or
    time are left out.

    A pause of a whole window forgets everything, so a key's requests part there and go to different tasks. Each part
    is sorted (on disk if need be) and passes by in batches: the time grows with the number of requests, and memory
    holds `most` times, however many requests one key has.
    """
    width = int(seconds * 1_000_000)
    rows = requests.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(request_id).alias("r"), F.col(time).alias("t"))
    ordered = _sessions(rows, width).repartition("k", "session").sortWithinPartitions("k", "session", "us", "r")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    decided = ordered.mapInArrow(_fold(width, most), f"k {kinds['k']}, r {kinds['r']}, t {kinds['t']}, accepted boolean")
    return decided.select(F.col("k").alias(key), F.col("r").alias(request_id), F.col("t").alias(time), "accepted")


def _fold(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[int] = deque()
        current = None
        for batch in batches:
            accepted = []
            for part, now in zip(zip(batch.column("k").to_pylist(), batch.column("session").to_pylist()), batch.column("us").to_pylist()):
                if part != current:
                    current = part
                    held.clear()
                while held and held[0] <= now - width:
                    held.popleft()
                accepted.append(len(held) < most)
                if accepted[-1]:
                    held.append(now)
            yield pa.record_batch([batch.column("k"), batch.column("r"), batch.column("t"), pa.array(accepted, pa.bool_())], names=["k", "r", "t", "accepted"])

    return run


def _sessions(rows: DataFrame, gap: int) -> DataFrame:
    """rows with a session number per key: a pause of a whole window forgets everything, so the folds may part there."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("us", "r")
    new = F.when(F.col("us") - F.lag("us").over(w) < gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rate_limited_stream(requests: DataFrame, key: str, time: str, request_id: str, seconds: float, most: int, late: str = "1 minute") -> DataFrame:
    """The same over a stream (append mode): state per key is the accepted times within the window."""
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, request_id)}

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            ordered = frame.sort_values([time, request_id])
            accepted = []
            for t in ordered[time]:
                now = pd.Timestamp(t).value / 1e9
                held = [u for u in held if u > now - seconds]
                accepted.append(len(held) < most)
                if accepted[-1]:
                    held.append(now)
            yield pd.DataFrame({key: k[0], request_id: ordered[request_id].to_numpy(), time: ordered[time].to_numpy(), "accepted": accepted})
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(max(int((max(held) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    rows = requests.select(F.col(key), F.col(request_id), F.col(time).cast("timestamp").alias(time)).withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {request_id} {kinds[request_id]}, {time} timestamp, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
