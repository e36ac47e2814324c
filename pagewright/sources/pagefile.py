"""Page files: a source with one partition for each range of pages, a sink, and store operations on page DataFrames (page_id, data).

A file holds page N at byte N * 4096 and nothing else. A tail shorter than a page is ignored on reading. Paths are plain paths or URIs that
every executor reaches.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from pagewright.functions.pages import PAGE_SIZE, zero_page
from pagewright.session import materialize

SCHEMA = "page_id long, data binary"
PAGES_A_PARTITION = 16_384
PAGES_A_BATCH = 512


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def exists(path: str) -> bool:
    store, p = _at(path)
    return store.get_file_info(p).type == fs.FileType.File


def page_count(path: str) -> int:
    """Whole pages of a file."""
    store, p = _at(path)
    return store.get_file_info(p).size // PAGE_SIZE


#: Lowest and highest page that a filter's value allows.
_BOUNDS = {
    EqualTo: lambda v: (v, v),
    GreaterThan: lambda v: (v + 1, 1 << 62),
    GreaterThanOrEqual: lambda v: (v, 1 << 62),
    LessThan: lambda v: (0, v - 1),
    LessThanOrEqual: lambda v: (0, v),
}


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("pagesperpartition", PAGES_A_PARTITION))
        self.low, self.high = int(options.get("minpage", 0)), int(options.get("maxpage", (1 << 62)))

    def partitions(self) -> list[_Range]:
        if not exists(self.path):
            raise FileNotFoundError(self.path)
        end = min(page_count(self.path), self.high + 1)
        return [_Range(a, min(a + self.size, end)) for a in range(max(0, self.low), end, self.size)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, p = _at(self.path)
        kind = pa.schema([("page_id", pa.int64()), ("data", pa.binary())])
        if part.first == part.last:
            return
        with store.open_input_file(p) as f:
            for a in range(part.first, part.last, PAGES_A_BATCH):
                z = min(a + PAGES_A_BATCH, part.last)
                f.seek(a * PAGE_SIZE)
                raw = f.read((z - a) * PAGE_SIZE)
                yield pa.RecordBatch.from_arrays([pa.array(range(a, z), pa.int64()), pa.array([raw[i * PAGE_SIZE : (i + 1) * PAGE_SIZE] for i in range(z - a)], pa.binary())], schema=kind)


class _PushingReader(_Reader):
    """For sessions with spark.sql.python.filterPushdown.enabled: others refuse a reader that takes filters."""

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on page_id are taken; the others go back."""
        for f in filters:
            v = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("page_id",) or not isinstance(v, int) or type(f) not in _BOUNDS:
                yield f
                continue
            low, high = _BOUNDS[type(f)](v)
            self.low, self.high = max(self.low, low), min(self.high, high)


class _Part(WriterCommitMessage):
    def __init__(self, path: str | None, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _raw(data: pa.BinaryArray | pa.LargeBinaryArray) -> pa.Buffer:
    """The bytes of an array's values, which lie in a row."""
    kind = np.int32 if pa.types.is_binary(data.type) else np.int64
    ends = np.frombuffer(data.buffers()[1], kind, len(data) + 1, data.offset * kind().itemsize)
    return data.buffers()[2][int(ends[0]) : int(ends[-1])]


class _Writer(DataSourceArrowWriter):
    """All tasks write their pages at the pages' places in one new file; the commit looks at the tasks' ranges only, and puts that file in place with one rename.

    A task that runs again writes the same places. On stores where nothing can be written at a place, each task writes a file of its own, and the
    commit joins them.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.own = options["path"], overwrite, uuid.uuid4().hex
        store, p = _at(self.path)
        self.placed, self.whole = isinstance(store, fs.LocalFileSystem), f"{p}.{self.own}.whole"
        if exists(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def _open(self, store: fs.FileSystem, name: str, first: int) -> IO[bytes] | pa.NativeFile:
        if not self.placed:
            return store.open_output_stream(name)
        out = open(self.whole, "wb", opener=lambda p, _: os.open(p, os.O_WRONLY | os.O_CREAT, 0o666))  # not cut off: others write it, too
        out.seek(first * PAGE_SIZE)
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        store, p = _at(self.path)
        store.create_dir(posixpath.dirname(p), recursive=True)
        name, first, last, out = f"{p}.{self.own}.{uuid.uuid4().hex}", None, None, None
        for b in batches:
            ids, data = b.column("page_id").to_pylist(), b.column("data")
            for page, n in zip(ids, pc.binary_length(data).to_pylist(), strict=True):
                if n != PAGE_SIZE:
                    raise ValueError(f"page {page} doesn't have {PAGE_SIZE} bytes")
                if last is not None and page != last + 1:
                    raise ValueError(f"page {page} follows page {last}")
                if page is None or page < 0:
                    raise ValueError("a page without a place")
                first, last = page if first is None else first, page
            if ids:
                out = out or self._open(store, name, first)
                out.write(_raw(data))
        if out is None:
            return _Part(None, 0, -1)
        if self.placed:
            out.flush()
            os.fsync(out.fileno())
        out.close()
        return _Part(name, first, last)

    def commit(self, parts: list) -> None:
        store, p = _at(self.path)
        parts = sorted((x for x in parts if x is not None and x.path), key=lambda x: x.first)
        next_ = 0
        for x in parts:
            if x.first != next_:
                raise ValueError(f"page {next_} is missing or double")
            next_ = x.last + 1
        if self.placed:
            with self._open(store, self.whole, 0) as out:
                out.truncate(next_ * PAGE_SIZE)
        else:
            with store.open_output_stream(self.whole) as out:
                for x in parts:
                    with store.open_input_stream(x.path) as f:
                        while chunk := f.read(1 << 22):
                            out.write(chunk)
        store.move(self.whole, p)
        self._clean(parts)

    def abort(self, parts: list) -> None:
        self._clean([x for x in parts if x is not None and x.path])
        store, _ = _at(self.path)
        if store.get_file_info(self.whole).type == fs.FileType.File:
            store.delete_file(self.whole)

    def _clean(self, parts: list) -> None:
        store, _ = _at(self.path)
        for x in parts:
            if not self.placed:
                store.delete_file(x.path)


class PageFile(DataSource):
    """spark.read.format("pagefile").option("minPage", ..).option("maxPage", ..).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "pagefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return (_PushingReader if self.options.get("pushfilters") == "true" else _Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def open_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pages of an existing file; an error if there is none."""
    if not exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(PageFile)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("pagefile").options(pushFilters=pushed, **options).load(path)


def create(spark: SparkSession, path: str) -> DataFrame:
    """A new file without pages; an error if there is one."""
    save(empty(spark), path)
    return open_pages(spark, path)


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    return open_pages(spark, path) if exists(path) else create(spark, path)


def save(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes pages 0 to n - 1 (each once) as a file."""
    pages.sparkSession.dataSource.register(PageFile)
    ordered = pages.select("page_id", "data").repartitionByRange("page_id").sortWithinPartitions("page_id")
    ordered.write.format("pagefile").mode("overwrite" if overwrite else "append").save(path)


def page_at(spark: SparkSession, path: str, page: int) -> DataFrame:
    """One page of a file by its place, without reading others: one row, or none if it doesn't exist."""
    return open_pages(spark, path, minPage=page, maxPage=page).where(F.col("page_id") == page)


def number(pages: DataFrame, *order: str) -> DataFrame:
    """pages with dense page ids in that order. Rows are sorted and written once; only a count for each task is looked at together."""
    sorted_ = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = materialize(sorted_, "numbered")
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = kept.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    begin = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("begin"))  # a row for each task
    return kept.withColumns({"task": task, "place": place}).join(begin, "task").withColumn("page_id", F.col("begin") + F.col("place")).drop("at", "task", "place", "begin")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all small files (under 2 GB each) below a path, by the built-in source: path, page_id, data."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") >= PAGE_SIZE)
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / PAGE_SIZE) - 1)).alias("page_id")
    return files.select("path", "content", ids).select("path", "page_id", F.expr(f"substring(content, cast(page_id * {PAGE_SIZE} + 1 as int), {PAGE_SIZE})").alias("data"))


# ---------------------------------------------------------------- store operations on pages (page_id, data)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read_page(pages: DataFrame, page: int) -> DataFrame:
    """One row, or none if the page doesn't exist."""
    return pages.where(F.col("page_id") == page)


def write_pages(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """pages with the data of changed (each page at most once). Pages that don't exist stay away: the result of missing() tells them."""
    new = changed.select("page_id", F.col("data").alias("new"))
    return pages.join(new, "page_id", "left").select("page_id", F.coalesce("new", "data").alias("data"))


def missing(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Of page ids those that aren't allocated, with their outcome."""
    return ids.join(pages, "page_id", "left_anti").select("page_id", F.lit("PageNotFound").alias("outcome"))


def allocate(pages: DataFrame, n: int = 1) -> DataFrame:
    """pages and n zero pages behind them. Ids are dense, so the first new one is the number of pages."""
    spark = pages.sparkSession
    count = pages.count()
    new = spark.range(count, count + n).select(F.col("id").alias("page_id"), zero_page().alias("data"))
    return pages.unionByName(new)


def size(pages: DataFrame) -> DataFrame:
    """page_count, file_size (whole pages)."""
    return pages.agg(F.count("*").alias("page_count"), (F.count("*") * PAGE_SIZE).alias("file_size"))
