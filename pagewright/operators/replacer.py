"""The FIFO order of frames by itself, replayed over traces of (trace_id, seq, op, frame_id).

Operations: access (a frame joins the queue on its first access), evictable, pinned, remove, evict (the first evictable frame in queue order leaves;
`value` is its number, null if there is none) and size (`value`: evictable frames, whether or not they were accessed).
Traces are folded like those of a pool: one task a trace, in seq order, with the state of the queue alone in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.pool import rows_by_key


class Fifo:
    def __init__(self):
        self.queue: dict[int, None] = {}
        self.free_to_go: set[int] = set()

    def apply(self, op: str, frame: int | None) -> int | None:
        if op == "size":
            return len(self.free_to_go)
        if op == "evict":
            victim = next((f for f in self.queue if f in self.free_to_go), None)
            if victim is not None:
                self.apply("remove", victim)
            return victim
        if frame is None:
            return None
        if op == "access":
            self.queue.setdefault(frame)
        elif op == "evictable":
            self.free_to_go.add(frame)
        elif op == "pinned":
            self.free_to_go.discard(frame)
        elif op == "remove":
            self.queue.pop(frame, None)
            self.free_to_go.discard(frame)
        return None


def replacer_events(trace: DataFrame) -> DataFrame:
    """trace_id, seq, op, frame_id, value: one row for each row of trace. Unknown operations and null frames change nothing."""
    names = ["trace_id", "seq", "op", "frame_id", "value"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def block() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("seq", "frame_id", "value")})

        for _, rows in rows_by_key(frames, 1):
            fifo = Fifo()
            for r in rows:
                out.append((*r, fifo.apply(r[2], r[3])))
                if len(out) == 10_000:
                    yield block()
                    out.clear()
        yield block()

    cols = [F.col("trace_id").cast("string").alias("trace_id"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("string").alias("op"), F.col("frame_id").cast("long").alias("frame_id")]
    return trace.select(*cols).repartition("trace_id").sortWithinPartitions("trace_id", "seq", "op", "frame_id").mapInPandas(run, "trace_id string, seq long, op string, frame_id long, value long")
