"""The buffer pool over a stream of trace rows: one state for each trace, kept between micro-batches.

Rows of a trace must arrive in seq order across micro-batches; within one they are sorted. A trace's rows of one micro-batch are in memory together:
bound them by the source's rate (maxFilesPerTrigger and the like). The state is the pool's, never the trace's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.functions.pages import hit_rate
from pagewright.operators.pool import COUNTERS, Pool


def pool_stream(trace: DataFrame, pool_size: int, disk_pages: int | None = 0, leak_on_not_found: bool = True) -> DataFrame:
    """trace_id, last_seq, the counters so far, hit_rate: in update mode one row for each trace and micro-batch that has rows of it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool.load(json.loads(state.get[0])) if state.exists else Pool(pool_size, disk_pages, leak_on_not_found)
        rows = pd.concat(list(frames)).sort_values(["seq", "op", "page_id"])  # one trace's rows of one micro-batch
        for op, page in zip(rows.op, rows.page_id.astype(object).where(rows.page_id.notna(), None), strict=True):
            pool.apply(op, None if page is None else int(page))
        state.update((json.dumps(pool.dump()),))
        yield pd.DataFrame([(key[0], rows.seq.max(), *pool.stats.values())], columns=["trace_id", "last_seq", *COUNTERS])

    out = trace.select("trace_id", "seq", "op", "page_id").groupBy("trace_id").applyInPandasWithState(run, "trace_id string, last_seq long, " + ", ".join(f"{c} long" for c in COUNTERS), "pool string", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("hit_rate", hit_rate("cache_hits", "cache_misses"))


def latest(updates: DataFrame) -> DataFrame:
    """Of collected updates the last of each trace."""
    cols = [c for c in updates.columns if c != "trace_id"]
    return updates.groupBy("trace_id").agg(F.max(F.struct(*cols)).alias("u")).select("trace_id", "u.*")
