"""Traces and pages made from the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.pages import PAYLOAD_SIZE, header_bytes, update_checksum, zero_bytes
from pagewright.session import table


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each event type: a write for each fourth event, else a read, of page user_id % 64."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "write").otherwise("read").alias("op"), (F.col("user_id") % 64).alias("page_id"))


def event_ops(spark: SparkSession, sf_dir: str, op: Column) -> DataFrame:
    """One trace for each event type: that operation, of page user_id % 64."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("user_id") % 64).alias("page_id"))


def order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each priority: reads of page o_custkey % 256."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("trace_id"), F.col("o_orderkey").alias("seq"), F.lit("read").alias("op"), (F.col("o_custkey") % 256).alias("page_id"))


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, part, data: each text's UTF-8 bytes over as many Data pages as it takes (one at least), zero padded, with lsn = doc_id and a right checksum."""
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    last = F.greatest(F.lit(0), F.ceil(F.length("raw") / PAYLOAD_SIZE) - 1).cast("long")
    parts = raw.select("doc_id", "raw", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    payload = F.expr(f"substring(raw, cast(part * {PAYLOAD_SIZE} + 1 as int), {PAYLOAD_SIZE})")
    full = F.substring(F.concat(payload, zero_bytes(PAYLOAD_SIZE)), 1, PAYLOAD_SIZE)
    return parts.select("doc_id", "part", update_checksum(F.concat(header_bytes(F.lit("Data"), F.lit(0), F.col("doc_id")), full)).alias("data"))
