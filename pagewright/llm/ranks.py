"""Places of rows within their key, without gathering a key's rows: rows lie in order over shards, and only a row for each shard is looked at together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from pagewright.session import materialize


def carried(rows: DataFrame, key: str = "doc_id", shard: str = "shard", at: str = "first", run: str = "run", name: str = "place") -> DataFrame:
    """rows with each one's place (from 0) among all rows of its key (null is a key).

    Shards are in the order of key; at orders a shard's rows; run is a row's place in its shard's run of that key. What earlier shards have of a shard's
    first key is added. The windows go over one row a shard.
    """
    ends = rows.groupBy(shard).agg(F.min_by(F.struct(F.col(key).alias("k")), at).alias("lead"), F.max_by(F.struct(F.col(key).alias("k"), F.col(run).alias("n")), at).alias("last"))
    by_shard = Window.orderBy(shard)
    ends = ends.select(shard, F.col("lead.k").alias("__lead"), F.col("last.k").alias("tail"), (F.col("last.n") + 1).alias("n"), F.lag(F.struct(F.col("last.k").alias("k"))).over(by_shard).alias("before"))
    goes_on = F.col("before").isNotNull() & F.col("before.k").eqNullSafe(F.col("__lead"))
    ends = ends.withColumn("goes_on", goes_on).withColumn("segment", F.sum((~(goes_on & F.col("__lead").eqNullSafe(F.col("tail")))).cast("int")).over(by_shard))
    ends = ends.withColumn("so_far", F.sum("n").over(Window.partitionBy("segment").orderBy(shard)))
    ends = ends.select(shard, "__lead", F.when(F.col("goes_on"), F.lag("so_far").over(by_shard)).otherwise(0).alias("__carry"))
    place = F.col(run) + F.when(F.col(key).eqNullSafe(F.col("__lead")), F.col("__carry")).otherwise(0)
    return rows.join(ends, shard).withColumn(name, place).drop("__lead", "__carry")


def numbered(rows: DataFrame, key: str, order: list[str | Column], name: str = "place") -> DataFrame:
    """rows with each one's place (from 0) within its key, a long; by order, equal rows as they come. Rows are sorted and written once."""
    kept = rows.columns
    dealt = rows.withColumn("__from", F.spark_partition_id()).repartitionByRange(key, *order, "__from").sortWithinPartitions(key, *order).select(*kept)
    at = kept.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, now, same = TaskContext.get().partitionId(), 0, None, -1
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(at)
            ids, null = col.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(col.is_null())
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
            i = np.arange(len(ids))
            runs = i - np.maximum.accumulate(np.where(new, i, 0))
            if first and now == (ids[0], null[0]):
                runs[: np.append(np.flatnonzero(new[1:]) + 1, len(ids))[0]] += same + 1
            now, same = (ids[-1], null[-1]), int(runs[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ids), shard, np.int32)), pa.array(first + i), pa.array(runs)], [*kept, "__shard", "__at", "__run"])
            first += len(ids)

    schema = StructType([*dealt.schema.fields]).add("__shard", IntegerType()).add("__at", LongType()).add("__run", LongType())
    return carried(materialize(dealt.mapInArrow(run, schema), "numbered"), key, "__shard", "__at", "__run", name).select(*kept, name)
