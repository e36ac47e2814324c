"""What pages hold while a trace runs through a buffer pool: which write a read sees, and which write of a page the file has at the end.

Bytes never enter the fold. It carries versions, a version being the seq of the row that wrote (that of write, or of the drop_write that lets a write guard go),
and tells for each row what was written back and since when a frame holds its page. What the file held when a page was loaded is the last write-back before, which
a window over the page's own rows finds; bytes come from the caller's table of payloads, joined by trace and seq.

A null version is the file's page as it was before the trace. Rows follow the order of pool.py; rows with a null seq are versions that can't be told from
the file's own page, and rows of one trace with equal seq are one version. Null traces are a trace of their own. An empty trace gives no rows. Columns of the trace other than its four are left out.

Scale: one shuffle deals traces to tasks as in pool.py, one more regroups rows by trace and page; memory is the pool's state in the fold, and windows spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.pool import Pool, in_order, rows_by_key

#: Operations that show a page's bytes.
READS = ("read", "fetch_read", "fetch_write")
_SCHEMA = "trace_id string, at long, seq long, op string, page_id long, outcome string, version long, loaded long, written array<struct<page_id: long, version: long>>"


class VersionedPool(Pool):
    """A pool that knows for each frame when its page was loaded and which write it holds."""

    def __init__(self, size: int, disk_pages: int | None = 0, leak_on_not_found: bool = True):
        super().__init__(size, disk_pages, leak_on_not_found)
        self.at, self.seq = 0, None
        self.loaded: dict[int, int] = {}
        self.version: dict[int, int | None] = {}
        self.written: list[dict] = []

    def _write_back(self, frame: int) -> None:
        if frame in self.dirty:
            self.written.append({"page_id": self.page_of[frame], "version": self.version[frame]})
        super()._write_back(frame)

    def _install(self, frame: int, page: int) -> None:
        super()._install(frame, page)
        self.loaded[frame], self.version[frame] = self.at, None

    def drop(self, page: int, wrote: bool) -> str:
        frame = self.frame_of.get(page)
        if wrote and frame is not None and self.pins[frame]:
            self.version[frame] = self.seq
        return super().drop(page, wrote)

    def step(self, seq: int | None, op: str, page: int | None) -> tuple[str, int | None, int | None, list[dict]]:
        """Outcome, version and time of load of the row's page (null where no page is shown), and what was written back."""
        self.at, self.seq, self.written = self.at + 1, seq, []
        outcome, _ = self.apply(op, page)
        frame = self.frame_of.get(page) if op in READS and outcome == "ok" else None
        return (outcome, None, None, self.written) if frame is None else (outcome, self.version[frame], self.loaded[frame], self.written)


def _folded(trace: DataFrame, pool_size: int, disk_pages: int | None, leak_on_not_found: bool) -> DataFrame:
    names = [c.split()[0] for c in _SCHEMA.split(", ")[:9]]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("seq", "page_id", "version", "loaded")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for _, rows in rows_by_key(frames, 1):
            pool = VersionedPool(pool_size, disk_pages, leak_on_not_found)
            for t, seq, op, page in rows:
                outcome, version, loaded, written = pool.step(seq, op, page)
                if written or loaded is not None:
                    out.append((t, pool.at, seq, op, page, outcome, version, loaded, written))
                if len(out) == 10_000:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    return in_order(trace).mapInPandas(run, _SCHEMA)


def page_reads(trace: DataFrame, pool_size: int, disk_pages: int | None = 0, leak_on_not_found: bool = True) -> DataFrame:
    """trace_id, seq, op, page_id, version: for each successful read, fetch_read and fetch_write the write whose bytes it is shown."""
    none = F.lit(None).cast("long")
    back = F.transform("written", lambda w: F.struct(w["page_id"].alias("page_id"), F.col("at").alias("since"), w["version"].alias("back"), none.alias("version"), F.lit(False).alias("shown")))
    read = F.struct("page_id", F.col("loaded").alias("since"), none.alias("back"), "version", F.lit(True).alias("shown"))
    folded = _folded(trace, pool_size, disk_pages, leak_on_not_found)
    rows = folded.select("trace_id", "seq", "op", F.explode(F.concat(back, F.when(F.col("loaded").isNotNull(), F.array(read)).otherwise(F.array()))).alias("x")).select("trace_id", "seq", "op", "x.*")
    before = Window.partitionBy("trace_id", "page_id").orderBy("since", "shown").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stored = rows.withColumn("stored", F.last("back", ignorenulls=True).over(before)).where("shown")
    return stored.select("trace_id", "seq", "op", "page_id", F.coalesce("version", "stored").alias("version"))


def stored_versions(trace: DataFrame, pool_size: int, disk_pages: int | None = 0, leak_on_not_found: bool = True) -> DataFrame:
    """trace_id, page_id, version: for each page that was written back the write that the file has at the end. Writes that are still in frames, or were deleted there, aren't in the file."""
    backs = _folded(trace, pool_size, disk_pages, leak_on_not_found).select("trace_id", "at", F.explode("written").alias("w"))
    return backs.groupBy("trace_id", F.col("w.page_id").alias("page_id")).agg(F.max_by("w.version", "at").alias("version"))


def stored_pages(trace: DataFrame, payloads: DataFrame, pool_size: int, disk_pages: int | None = 0, leak_on_not_found: bool = True) -> DataFrame:
    """trace_id, page_id, version, data: those pages with their bytes. payloads: trace_id, seq, data, a row for each write; a write without one has null data."""
    known = payloads.select(F.col("trace_id").cast("string").alias("trace"), F.col("seq").cast("long").alias("version"), "data").alias("p")
    got = stored_versions(trace, pool_size, disk_pages, leak_on_not_found).alias("g")
    same = F.col("g.trace_id").eqNullSafe(F.col("p.trace")) & (F.col("g.version") == F.col("p.version"))
    return got.join(known, same, "left").select("trace_id", "page_id", "g.version", "data")
