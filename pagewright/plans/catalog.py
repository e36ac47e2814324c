"""Queries by name, and DuckDB SQL for the same results.

Names page_* and pool_* stand for the page store itself. Names ext_* are plain Spark SQL on the relational tables, which both engines run
from the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.operators.contents import page_reads, stored_pages
from pagewright.operators.pool import pool_events, pool_stats
from pagewright.operators.replacer import replacer_events
from pagewright.plans import traces
from pagewright.sources import pagefile
from pagewright.session import scratch_path, table

POOL, SWEEP = 16, [4, 8, 16, 32, 48, 64]
Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- pool


def pool_fifo_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_stats(traces.event_trace(spark, sf_dir), [POOL], 64).select("trace_id", "cache_hits", "cache_misses", "evictions", "hit_rate")


def pool_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pool_stats(traces.event_trace(spark, sf_dir), [POOL], 64)
    return got.drop("pool_size").withColumn("summary", P.stats_text("cache_hits", "cache_misses", "evictions"))


def pool_capacity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_stats(traces.event_trace(spark, sf_dir), SWEEP, 64).select("trace_id", "pool_size", "cache_hits", "cache_misses", "evictions")


def pool_order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_stats(traces.order_trace(spark, sf_dir), [64], 256).select("trace_id", "cache_hits", "cache_misses", "evictions", "pages_read", "pages_written", "hit_rate")


def pool_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes where only 60 of the 64 pages exist and a failed fetch loses its frame."""
    got = pool_events(traces.event_trace(spark, sf_dir), POOL, 60)
    return got.groupBy("trace_id", "outcome").agg(F.count("*").alias("n"), F.max("evictions").alias("evictions")).withColumn("message", P.outcome_message("outcome", F.lit(None)))


def _asked(trace: DataFrame, *ops: str) -> DataFrame:
    """trace, then for each page that it names those questions, behind all else."""
    ask = trace.select("trace_id", "page_id").distinct().withColumn("op", F.explode(F.array(*map(F.lit, ops))))
    return trace.unionByName(ask.select("trace_id", (F.lit(1 << 40) + F.col("page_id")).alias("seq"), "op", "page_id"))


def pool_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pin counts and residency at the end, where guards are taken and dropped (every third event drops one, also where none is held)."""
    t = traces.event_ops(spark, sf_dir, F.when(F.col("event_id") % 3 == 0, "drop_read").otherwise("fetch_read"))
    got = pool_events(_asked(t, "contains", "pin_count"), 64, 64).where(F.col("seq") >= 1 << 40)
    return got.groupBy("trace_id", "page_id").agg(F.max(F.when(F.col("op") == "contains", F.col("value"))).alias("resident"), F.max(F.when(F.col("op") == "pin_count", F.col("value"))).alias("pins"), F.max("cache_hits").alias("cache_hits"), F.max("cache_misses").alias("cache_misses"))


def pool_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write guards that are never dropped: after as many pages as frames each further page finds no free frame."""
    got = pool_events(traces.event_ops(spark, sf_dir, F.lit("fetch_write")), 4, 64)
    return got.groupBy("trace_id", "outcome").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("evictions").alias("evictions")).withColumn("message", P.outcome_message("outcome", F.lit(None)))


def pool_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new and allocated pages, the file's pages and the pool's free frames, event by event; new pages stay pinned, so frames run out while ids go on."""
    n = F.col("event_id") % 4
    t = traces.event_ops(spark, sf_dir, F.when(n == 0, "new").when(n == 1, "alloc").when(n == 2, "disk_pages").otherwise("free_frames"))
    return pool_events(t, 64, 0).select("trace_id", "seq", "op", "outcome", "value")


def pool_delete_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes, reads, flushes and deletes of pages that all have room: what is written back, and what has to be read again."""
    n = F.col("event_id") % 5
    t = traces.event_ops(spark, sf_dir, F.when(n < 2, "write").when(n == 2, "read").when(n == 3, "flush").otherwise("delete"))
    last = pool_events(_asked(t, "contains"), 64, 64)
    return last.groupBy("trace_id").agg(*(F.max(c).alias(c) for c in ("cache_hits", "cache_misses", "evictions", "pages_read", "pages_written")), F.sum(F.when(F.col("op") == "contains", F.col("value"))).alias("resident"))


def pool_delete_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of pages of which half are held: refused while a guard is out, carried out else."""
    t = traces.event_ops(spark, sf_dir, F.when(F.col("event_id") % 5 == 4, "delete").when(F.col("user_id") % 2 == 0, "fetch_read").otherwise("read"))
    return pool_events(t, 64, 64).where("op = 'delete'").groupBy("trace_id", "page_id", "outcome").agg(F.count("*").alias("n")).withColumn("message", P.outcome_message("outcome", "page_id"))


def pool_flush_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes, and every fiftieth event a flush of all pages: pages written after each flush."""
    t = traces.event_ops(spark, sf_dir, F.when(F.col("event_id") % 50 == 0, "flush_all").otherwise("write"))
    return pool_events(t, 64, 64).where("op = 'flush_all'").select("trace_id", "seq", "pages_written")


def pool_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at the end, where every hundredth event resets them."""
    t = traces.event_ops(spark, sf_dir, F.when(F.col("event_id") % 100 == 0, "reset_stats").otherwise("read"))
    got = pool_stats(t, [64], 64).drop("pool_size", "evictions", "pages_written")
    return got.withColumn("summary", P.stats_text("cache_hits", "cache_misses", F.lit(0)))


def pool_contents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write that each read is shown, in a pool of a quarter of the pages: most come back from the file."""
    return page_reads(traces.event_trace(spark, sf_dir), POOL, 64)


def pool_contents_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the pages in the file at the end, where every fiftieth event flushes all and others write a page of their own: the last writes before the last flush."""
    n = F.col("event_id") % 50
    trace = traces.event_ops(spark, sf_dir, F.when(n == 0, "flush_all").otherwise("write"))
    data = P.update_checksum(P.set_header(P.zero_page(), F.lit("Data"), F.lit(0), F.col("seq")))
    got = stored_pages(trace, trace.where("op = 'write'").select("trace_id", "seq", data.alias("data")), 64, 64)
    h = P.header("data")
    return got.select("trace_id", "page_id", h["page_type"].alias("page_type"), h["lsn"].cast("long").alias("lsn"), P.verify_checksum("data").alias("checksum_ok"))


def pool_replacer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations of the bare FIFO order by turns; what each question and each eviction said."""
    e = table(spark, sf_dir, "events")
    k = F.element_at(F.array(*map(F.lit, _REPLACER)), (F.col("event_id") % len(_REPLACER) + 1).cast("int"))
    got = replacer_events(e.select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), k.alias("op"), (F.col("user_id") % 32).alias("frame_id")))
    return got.where("op in ('evict', 'size')").groupBy("trace_id", "op").agg(F.count("*").alias("asked"), F.count("value").alias("told"), F.sum("value").alias("sum"))


#: The operations in turn.
_REPLACER = ["access", "evictable", "size", "access", "evictable", "evict", "pinned", "evictable", "remove", "access", "evict"]


def pool_missing_pages_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where failed fetches give their frame back."""
    return pool_events(traces.event_trace(spark, sf_dir), POOL, 60, False).groupBy("trace_id", "outcome").agg(F.count("*").alias("n"))


def pool_replacer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Victims of the bare FIFO order: frames are accessed and freed by turns, and each fifth event evicts."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 5 == 0, "evict").when(F.col("event_id") % 2 == 0, "access").otherwise("evictable")
    got = replacer_events(e.select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("user_id") % 32).alias("frame_id")))
    victims = got.where("op = 'evict'").groupBy("trace_id").agg(F.count("*").alias("asked"), F.count("value").alias("evicted"), F.sum("value").alias("frame_sum"))
    return victims.withColumn("last", P.frame_id_text("frame_sum"))


def _fold(tables: str, size: str, group: str, dirty: bool = False) -> str:
    """SQL for a FIFO fold over `tables` (trace_id, seq, page, w), for pools of `size`."""
    full = f"len(a.q) >= {size}"
    d_after = f"CASE WHEN {full} THEN list_filter(a.d, lambda y: y <> a.q[1]) ELSE a.d END"
    touch = "CASE WHEN b.x AND NOT list_contains({d}, b.p) THEN list_append({d}, b.p) ELSE {d} END"
    hit = f"{{'q': a.q, 'd': {touch.format(d='a.d')}, 'h': a.h + 1, 'm': a.m, 'e': a.e, 'w': a.w, 'p': b.p, 'x': b.x}}"
    miss = (
        f"{{'q': CASE WHEN {full} THEN list_append(a.q[2:], b.p) ELSE list_append(a.q, b.p) END, 'd': {touch.format(d='(' + d_after + ')')}, 'h': a.h, 'm': a.m + 1, 'e': a.e + CASE WHEN {full} THEN 1 ELSE 0 END, "
        f"'w': a.w + CASE WHEN {full} AND list_contains(a.d, a.q[1]) THEN 1 ELSE 0 END, 'p': b.p, 'x': b.x}}"
    )
    if not dirty:
        hit, miss = hit.replace(touch.format(d="a.d"), "a.d"), miss.replace(touch.format(d="(" + d_after + ")"), "a.d")
    zero = "{'q': []::BIGINT[], 'd': []::BIGINT[], 'h': 0::BIGINT, 'm': 0::BIGINT, 'e': 0::BIGINT, 'w': 0::BIGINT, 'p': -1::BIGINT, 'x': false}"
    item = "{'q': []::BIGINT[], 'd': []::BIGINT[], 'h': 0::BIGINT, 'm': 0::BIGINT, 'e': 0::BIGINT, 'w': 0::BIGINT, 'p': page::BIGINT, 'x': w}"
    return f"""WITH t AS ({tables}), g AS (
  SELECT {group}, list_prepend({zero}, list({item} ORDER BY seq)) AS s FROM t GROUP BY {group}
), f AS (
  SELECT {group}, list_reduce(s, lambda a, b: CASE WHEN list_contains(a.q, b.p) THEN {hit} ELSE {miss} END) AS r FROM g
)"""


_EVENTS = "SELECT event_type AS trace_id, event_id AS seq, user_id % 64 AS page, event_id % 4 = 0 AS w FROM events"
_ORDERS = "SELECT o_orderpriority AS trace_id, o_orderkey AS seq, o_custkey % 256 AS page, false AS w FROM orders"
_RATE = "CASE WHEN r.h + r.m > 0 THEN r.h / (r.h + r.m) ELSE 0.0 END AS hit_rate"

# ---------------------------------------------------------------- pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.document_pages(table(spark, sf_dir, "documents"))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of every page, decoded from its bytes."""
    d = _pages(spark, sf_dir)
    h = P.header("data")
    return d.select("doc_id", "part", h["page_type"].alias("page_type"), h["lsn"].cast("long").alias("lsn"), P.verify_checksum("data").alias("checksum_ok"), P.page_id_text("part").alias("shown"), F.length("data").cast("long").alias("n_bytes"))


def page_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pages(spark, sf_dir)
    return d.select("doc_id", "part", P.header("data")["checksum"].alias("checksum"))


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by type and class; every seventh document's pages are overwritten by zero pages, every fifth one's get a flipped byte."""
    d = _pages(spark, sf_dir)
    flipped = F.concat(F.substring("data", 1, P.PAGE_SIZE - 1), F.unhex(F.lit("01")))
    d = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, P.zero_page()).when(F.col("doc_id") % 5 == 0, flipped).otherwise(F.col("data")).alias("data"))
    h = P.header("data")
    per = d.groupBy(h["page_type"].alias("page_type"), P.page_class("data").alias("class"))
    return per.agg(F.count("*").alias("page_count"), (F.count("*") * P.PAGE_SIZE).alias("file_size"), F.max(h["lsn"]).cast("long").alias("max_lsn"))


def page_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and lsn of every page are set anew and read back; every tenth page is freed."""
    d = _pages(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 10 == 0, "Free").otherwise("BTreeLeaf")
    new = P.update_checksum(P.set_header("data", kind, F.lit(0), F.col("doc_id") * 2 + F.col("part")))
    d = d.select("doc_id", "part", new.alias("data"))
    h = P.header("data")
    return d.groupBy(h["page_type"].alias("page_type")).agg(F.count("*").alias("n"), F.sum(h["lsn"]).cast("long").alias("lsn_sum"), F.sum(P.verify_checksum("data").cast("long")).alias("ok"))


def _file(spark: SparkSession, sf_dir: str) -> str:
    """All documents' pages as one page file."""
    path = scratch_path(spark, "pages") + ".db"
    pagefile.save(pagefile.number(_pages(spark, sf_dir), "doc_id", "part").select("page_id", "data"), path)
    return path


def page_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pages written to a page file by the sink and read back by the source."""
    d = pagefile.open_or_create(spark, _file(spark, sf_dir))
    h = P.header("data")
    return d.select("page_id", h["page_type"].alias("page_type"), h["lsn"].cast("long").alias("lsn"), P.verify_checksum("data").alias("checksum_ok"))


def page_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bytes of that file, and of one made empty."""
    made = pagefile.size(pagefile.open_pages(spark, _file(spark, sf_dir))).withColumn("file", F.lit("documents"))
    return made.unionByName(pagefile.size(pagefile.create(spark, scratch_path(spark, "pages") + ".db")).withColumn("file", F.lit("empty")))


def page_file_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of that file read one by one by their place, the last one past its end."""
    path = _file(spark, sf_dir)
    n = pagefile.page_count(path)
    out = None
    for page in (0, n // 2, n - 1, n):
        got = pagefile.page_at(spark, path, page).select("page_id", P.header("data")["lsn"].cast("long").alias("lsn"), P.page_class("data").alias("state"))
        out = got if out is None else out.unionByName(got)
    return out


def page_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That file's pages with three more allocated, by class: new pages are zero."""
    d = pagefile.allocate(pagefile.open_pages(spark, _file(spark, sf_dir)), 3)
    return d.groupBy(P.page_class("data").alias("state")).agg(F.count("*").alias("n"), F.max("page_id").alias("last")).withColumn("shown", P.page_id_text(P.page_id("last")))


def page_new_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new header of each document's type code, its bytes, and what they decode to."""
    d = table(spark, sf_dir, "documents").select("doc_id", P.new_header(P.page_type_name(F.col("doc_id") % 7)).alias("h"))
    raw = P.header_bytes("h.page_type", "h.checksum", "h.lsn")
    back = P.header(raw)
    return d.select("doc_id", F.lower(F.hex(raw)).alias("raw"), back["page_type"].alias("page_type"), back["checksum"].alias("checksum"), back["lsn"].cast("long").alias("lsn"))


def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and frame ids as shown; the sentinel, made of each hundredth document, is no page."""
    n = F.when(F.col("doc_id") % 100 == 0, F.lit(P.INVALID_PAGE_ID)).otherwise(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", P.page_id(n).isNotNull().alias("valid"), P.page_id_text(P.page_id(n)).alias("page"), P.frame_id_text("doc_id").alias("frame"), *(P.outcome_message(F.lit(k), n, F.lit("cause")).alias(k) for k in P.MESSAGES))


def page_store_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages, five of them allocated late, written to by all of nation: what is where."""
    return _stored(spark, table(spark, sf_dir, "nation"))


def _stored(spark: SparkSession, nation: DataFrame) -> DataFrame:
    first = spark.range(5).select(F.col("id").alias("page_id"), P.zero_page().alias("data"))
    pages = pagefile.allocate(first, 5)
    n = nation.select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name"))
    data = F.substring(F.concat(P.header_bytes(F.lit("Data"), F.lit(0), F.lit(1)), F.encode("n_name", "utf-8"), P.zero_page()), 1, P.PAGE_SIZE)
    changed = n.select("page_id", P.update_checksum(data).alias("data"))
    now = pagefile.write_pages(pages, changed).select("page_id", P.page_class("data").alias("state"))
    lost = pagefile.missing(pages, changed.select("page_id"))
    return now.unionByName(lost.select("page_id", F.col("outcome").alias("state")))


_PARTS = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, unnest(range(0, greatest(1, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4083.0) AS BIGINT)))) AS part FROM documents"

# ---------------------------------------------------------------- plain SQL, the same text for both engines

SHARED = {
    "ext_equi_join_agg": "SELECT c_mktsegment, o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment, o_orderstatus",
    "ext_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "ext_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "ext_outer_join": "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "ext_rollup": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "ext_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_distinct_agg": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "ext_rank": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "ext_lag": "SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events",
    "ext_running_sum": "SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM orders",
    "ext_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "ext_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "ext_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "ext_except": "SELECT CAST(p_size AS BIGINT) AS k FROM part EXCEPT SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation",
    "ext_range_join": "SELECT p_size AS size, count(*) AS n FROM part JOIN (SELECT DISTINCT CAST(l_quantity AS INT) AS q FROM lineitem) x ON p_size BETWEEN q AND q + 2 GROUP BY p_size",
}


def _shared(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if t in sql.split() or f"{t})" in sql]
        return spark.sql(_named(sql, names), **{t: table(spark, sf_dir, t) for t in names})

    return run


def _named(sql: str, names: list[str]) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", lambda m: f"{m[1]} {{{m[2]}}} AS {m[2]}", sql)


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return e.groupBy(w.start.cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def ext_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from a quantity to two above it: each quantity is listed with the three sizes it meets, so the join is one of equal keys, never a nested loop."""
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct()
    met = q.select(F.explode(F.sequence("q", F.col("q") + 2)).alias("size"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("parts"))
    return parts.join(met.groupBy("size").agg(F.count("*").alias("quantities")), "size").select("size", (F.col("parts") * F.col("quantities")).alias("n"))


def ext_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


_OPS = "SELECT event_type AS trace_id, event_id AS seq, user_id % 64 AS page, user_id, event_id FROM events"


def _missing(kept: bool, last: str) -> str:
    """SQL for the fold where pages from 60 on are missing: a failed fetch loses its frame, or gives it back."""
    zero = "{'q': []::BIGINT[], 'f': 16::BIGINT, 'ok': 0::BIGINT, 'nf': 0::BIGINT, 'none': 0::BIGINT, 'e': 0::BIGINT, 'eok': 0::BIGINT, 'enf': 0::BIGINT, 'enone': 0::BIGINT, 'p': -1::BIGINT}"
    hit = "{'q': a.q, 'f': a.f, 'ok': a.ok + 1, 'nf': a.nf, 'none': a.none, 'e': a.e, 'eok': a.e, 'enf': a.enf, 'enone': a.enone, 'p': b.p}"
    stuck = "{'q': a.q, 'f': a.f, 'ok': a.ok, 'nf': a.nf, 'none': a.none + 1, 'e': a.e, 'eok': a.eok, 'enf': a.enf, 'enone': a.e, 'p': b.p}"
    e, q, f = "a.e + CASE WHEN a.f = 0 THEN 1 ELSE 0 END", "CASE WHEN a.f = 0 THEN a.q[2:] ELSE a.q END", "greatest(a.f - 1, 0)"
    lost = f"{{'q': {q}, 'f': {f}{' + 1' if kept else ''}, 'ok': a.ok, 'nf': a.nf + 1, 'none': a.none, 'e': {e}, 'eok': a.eok, 'enf': {e}, 'enone': a.enone, 'p': b.p}}"
    got = f"{{'q': list_append({q}, b.p), 'f': {f}, 'ok': a.ok + 1, 'nf': a.nf, 'none': a.none, 'e': {e}, 'eok': {e}, 'enf': a.enf, 'enone': a.enone, 'p': b.p}}"
    return f"""WITH g AS (SELECT trace_id, list_prepend({zero}, list({zero.replace("-1::BIGINT", "page::BIGINT")} ORDER BY seq)) AS s FROM ({_EVENTS}) GROUP BY trace_id
), r AS (SELECT trace_id, list_reduce(s, lambda a, b: CASE WHEN list_contains(a.q, b.p) THEN {hit} WHEN a.f = 0 AND len(a.q) = 0 THEN {stuck} WHEN b.p >= 60 THEN {lost} ELSE {got} END) AS r FROM g
), o AS (SELECT trace_id, unnest([{{'o': 'ok', 'n': r.ok, 'e': r.eok, 'm': NULL}}, {{'o': 'PageNotFound', 'n': r.nf, 'e': r.enf, 'm': 'Page 4294967295 not found'}}, {{'o': 'NoFreeFrames', 'n': r.none, 'e': r.enone, 'm': 'No free frames available in buffer pool'}}]) AS x FROM r)
SELECT trace_id, x.o AS outcome, x.n AS n{last} FROM o WHERE x.n > 0"""


def _replacer(op: str, last: str) -> str:
    """SQL for the bare FIFO order: queue q, evictable frames s, and what evictions (v) and sizes (z) gave."""
    zero = "{'q': []::BIGINT[], 's': []::BIGINT[], 'ea': 0::BIGINT, 'et': 0::BIGINT, 'es': 0::BIGINT, 'za': 0::BIGINT, 'zs': 0::BIGINT, 'op': '', 'p': -1::BIGINT}"

    def state(q: str = "a.q", s: str = "a.s", ea: str = "a.ea", et: str = "a.et", es: str = "a.es", za: str = "a.za", zs: str = "a.zs") -> str:
        return f"{{'q': {q}, 's': {s}, 'ea': {ea}, 'et': {et}, 'es': {es}, 'za': {za}, 'zs': {zs}, 'op': b.op, 'p': b.p}}"

    victim = "list_filter(a.q, lambda x: list_contains(a.s, x))[1]"
    cases = {
        "access": state(q="CASE WHEN list_contains(a.q, b.p) THEN a.q ELSE list_append(a.q, b.p) END"),
        "evictable": state(s="CASE WHEN list_contains(a.s, b.p) THEN a.s ELSE list_append(a.s, b.p) END"),
        "pinned": state(s="list_filter(a.s, lambda x: x <> b.p)"),
        "remove": state(q="list_filter(a.q, lambda x: x <> b.p)", s="list_filter(a.s, lambda x: x <> b.p)"),
        "size": state(za="a.za + 1", zs="a.zs + len(a.s)"),
        "evict": f"CASE WHEN {victim} IS NULL THEN {state(ea='a.ea + 1')} ELSE {state(q=f'list_filter(a.q, lambda x: x <> {victim})', s=f'list_filter(a.s, lambda x: x <> {victim})', ea='a.ea + 1', et='a.et + 1', es=f'a.es + {victim}')} END",
    }
    fold = "CASE b.op " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " ELSE a END"
    item = zero.replace("'op': ''", f"'op': {op}").replace("-1::BIGINT", "(user_id % 32)::BIGINT")
    return f"WITH g AS (SELECT event_type AS trace_id, list_prepend({zero}, list({item} ORDER BY event_id)) AS s FROM events GROUP BY 1), r AS (SELECT trace_id, list_reduce(s, lambda a, b: {fold}) AS r FROM g) {last}"


#: CRC-32 (reflected 0xEDB88320) of every page's bytes with the checksum's four bytes as zero, byte by byte over a table.
_CRC_SQL = f"""WITH RECURSIVE c AS (SELECT i, i::UBIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM c WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8
), d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (SELECT doc_id, x, unnest(range(0, greatest(1, CAST(ceil(len(x) / 8166.0) AS BIGINT)))) AS part FROM d
), b AS (SELECT doc_id, part, '01' || '00000000' || array_to_string(list_transform(range(8), lambda j: lpad(hex((doc_id >> (8 * j)::INT) & 255), 2, '0')), '') || rpad(x[part * 8166 + 1 : part * 8166 + 8166], 8166, '0') AS h FROM p
)
SELECT doc_id, part, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::UBIGINT)), lambda s, y: xor(s // 256, t[(xor(s % 256, y) + 1)::BIGINT])), 4294967295::UBIGINT) AS BIGINT) AS checksum FROM b, tab"""

_NUMBERED = "SELECT row_number() OVER (ORDER BY doc_id, part) - 1 AS page_id, doc_id FROM ({_PARTS})".replace("{_PARTS}", _PARTS)

QUERIES: dict[str, Query] = {name: _shared(sql) for name, sql in SHARED.items()} | {
    f.__name__: f for f in (pool_fifo_hit_rate, pool_stats_full, pool_capacity_sweep, pool_order_trace, pool_missing_pages, pool_missing_pages_kept, pool_replacer, pool_pins, pool_exhausted, pool_new_pages, pool_delete_flush, pool_delete_pinned, pool_flush_all, pool_reset, pool_contents_read, pool_contents_stored, pool_replacer_all, page_headers, page_checksums, page_inventory, page_reencode, page_store_nation, page_file, page_file_size, page_file_reads, page_allocated, page_new_headers, page_ids, ext_tumbling, ext_session, ext_json_props, ext_range_join)
}

ORACLES: dict[str, str] = SHARED | {
    "pool_fifo_hit_rate": _fold(_EVENTS, "16", "trace_id") + f" SELECT trace_id, r.h AS cache_hits, r.m AS cache_misses, r.e AS evictions, {_RATE} FROM f",
    "pool_stats_full": _fold(_EVENTS, "16", "trace_id", True)
    + f" SELECT trace_id, r.h AS cache_hits, r.m AS cache_misses, r.e AS evictions, r.m AS pages_read, r.w AS pages_written, {_RATE}, printf('Stats {{ hits: %d, misses: %d, evictions: %d, hit_rate: %.2f%% }}', r.h, r.m, r.e, 100.0 * r.h / (r.h + r.m)) AS summary FROM f",
    "pool_capacity_sweep": _fold(f"SELECT trace_id, seq, page, w, unnest({SWEEP}) AS pool_size FROM ({_EVENTS})", "a.z", "trace_id, pool_size")
    .replace("'p': -1::BIGINT", "'z': pool_size, 'p': -1::BIGINT")
    .replace("'p': page::BIGINT", "'z': pool_size, 'p': page::BIGINT")
    .replace("'p': b.p", "'z': b.z, 'p': b.p")
    + " SELECT trace_id, CAST(pool_size AS INT) AS pool_size, r.h AS cache_hits, r.m AS cache_misses, r.e AS evictions FROM f",
    "pool_order_trace": _fold(_ORDERS, "64", "trace_id") + f" SELECT trace_id, r.h AS cache_hits, r.m AS cache_misses, r.e AS evictions, r.m AS pages_read, CAST(0 AS BIGINT) AS pages_written, {_RATE} FROM f",
    "page_headers": f"SELECT doc_id, part, 'Data' AS page_type, doc_id AS lsn, true AS checksum_ok, 'Page(' || part || ')' AS shown, CAST(4096 AS BIGINT) AS n_bytes FROM ({_PARTS})",
    "page_inventory": f"SELECT CASE WHEN doc_id % 7 = 0 THEN 'Invalid' ELSE 'Data' END AS page_type, CASE WHEN doc_id % 7 = 0 THEN 'zero' WHEN doc_id % 5 = 0 THEN 'corrupt' ELSE 'ok' END AS class, count(*) AS page_count, count(*) * 4096 AS file_size, max(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id END) AS max_lsn FROM ({_PARTS}) GROUP BY 1, 2",
    "page_reencode": f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'Free' ELSE 'BTreeLeaf' END AS page_type, count(*) AS n, CAST(sum(doc_id * 2 + part) AS BIGINT) AS lsn_sum, count(*) AS ok FROM ({_PARTS}) GROUP BY 1",
    "page_store_nation": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, CASE WHEN n_nationkey < 10 THEN 'ok' ELSE 'PageNotFound' END AS state FROM nation",
    "pool_missing_pages": _missing(False, ", x.e AS evictions, x.m AS message"),
    "pool_missing_pages_kept": _missing(True, ""),
    "pool_replacer": _replacer("CASE WHEN event_id % 5 = 0 THEN 'evict' WHEN event_id % 2 = 0 THEN 'access' ELSE 'evictable' END", "SELECT trace_id, r.ea AS asked, r.et AS evicted, CASE WHEN r.et > 0 THEN r.es END AS frame_sum, CASE WHEN r.et > 0 THEN 'Frame(' || r.es || ')' END AS last FROM r"),
    "pool_replacer_all": _replacer(f"{_REPLACER}[event_id % {len(_REPLACER)} + 1]", "SELECT trace_id, 'evict' AS op, r.ea AS asked, r.et AS told, CASE WHEN r.et > 0 THEN r.es END AS sum FROM r WHERE r.ea > 0 UNION ALL SELECT trace_id, 'size', r.za, r.za, r.zs FROM r WHERE r.za > 0"),
    "pool_pins": f"""WITH t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS d FROM ({_OPS})
), w AS (SELECT *, sum(d) OVER (PARTITION BY trace_id, page ORDER BY seq) AS s FROM t
), p AS (SELECT trace_id, page, CAST(sum(d) AS BIGINT) AS s, least(0, min(s)) AS lo, count(*) FILTER (d = 1) AS f FROM w GROUP BY 1, 2
), h AS (SELECT trace_id, sum(f) AS f, count(*) FILTER (f > 0) AS m FROM p GROUP BY 1)
SELECT trace_id, page AS page_id, CAST(p.f > 0 AS BIGINT) AS resident, CAST(CASE WHEN p.f > 0 THEN s - lo END AS BIGINT) AS pins, CAST(h.f - m AS BIGINT) AS cache_hits, m AS cache_misses FROM p JOIN h USING (trace_id)""",
    "pool_exhausted": f"""WITH a AS (SELECT trace_id, page, min(seq) AS s FROM ({_OPS}) GROUP BY 1, 2
), k AS (SELECT trace_id, page, row_number() OVER (PARTITION BY trace_id ORDER BY s) AS r FROM a
), o AS (SELECT trace_id, seq, CASE WHEN r <= 4 THEN 'ok' ELSE 'NoFreeFrames' END AS outcome FROM ({_OPS}) JOIN k USING (trace_id, page))
SELECT trace_id, outcome, count(*) AS n, min(seq) AS first, CAST(0 AS BIGINT) AS evictions, CASE WHEN outcome = 'ok' THEN NULL ELSE 'No free frames available in buffer pool' END AS message FROM o GROUP BY 1, 2""",
    "pool_new_pages": f"""WITH t AS (SELECT *, event_id % 4 AS k FROM ({_OPS})
), c AS (SELECT *, sum((k < 2)::INT) OVER w AS made, sum((k = 0)::INT) OVER w AS news FROM t WINDOW w AS (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT trace_id, seq, ['new', 'alloc', 'disk_pages', 'free_frames'][k + 1] AS op, CASE WHEN k = 0 AND news > 64 THEN 'NoFreeFrames' ELSE 'ok' END AS outcome, CAST(CASE WHEN k < 2 THEN made - 1 WHEN k = 2 THEN made ELSE greatest(0, 64 - news) END AS BIGINT) AS value FROM c""",
    "pool_delete_flush": f"""WITH t AS (SELECT *, CASE WHEN event_id % 5 < 3 THEN 'a' WHEN event_id % 5 = 3 THEN 'f' ELSE 'd' END AS k, event_id % 5 < 2 AS w FROM ({_OPS})
), a AS (SELECT trace_id, page, seq, k, lag(k) OVER (PARTITION BY trace_id, page ORDER BY seq) AS b, row_number() OVER (PARTITION BY trace_id, page ORDER BY seq DESC) AS r FROM t WHERE k <> 'f'
), x AS (SELECT trace_id, count(*) FILTER (k = 'a' AND b = 'a') AS h, count(*) FILTER (k = 'a' AND b IS DISTINCT FROM 'a') AS m, count(*) FILTER (r = 1 AND k = 'a') AS n FROM a GROUP BY 1
), f AS (SELECT trace_id, seq, k, lag(CASE WHEN w THEN 'w' ELSE k END) OVER (PARTITION BY trace_id, page ORDER BY seq) AS b FROM t WHERE w OR k <> 'a'
), y AS (SELECT trace_id, count(*) FILTER (k = 'f' AND b = 'w') AS w FROM f GROUP BY 1)
SELECT trace_id, h AS cache_hits, m AS cache_misses, CAST(0 AS BIGINT) AS evictions, m AS pages_read, coalesce(w, 0) AS pages_written, n AS resident FROM x LEFT JOIN y USING (trace_id)""",
    "pool_delete_pinned": f"""WITH t AS (SELECT *, event_id % 5 = 4 AS d FROM ({_OPS})
), h AS (SELECT *, count(*) FILTER (NOT d) OVER (PARTITION BY trace_id, page ORDER BY seq) AS f FROM t
), o AS (SELECT trace_id, page AS page_id, CASE WHEN page % 2 = 0 AND f > 0 THEN 'PageNotPinned' ELSE 'ok' END AS outcome FROM h WHERE d)
SELECT trace_id, page_id, outcome, count(*) AS n, CASE WHEN outcome <> 'ok' THEN 'Page ' || page_id || ' is not pinned' END AS message FROM o GROUP BY 1, 2, 3""",
    "pool_flush_all": f"""WITH t AS (SELECT *, event_id % 50 = 0 AS k FROM ({_OPS})
), g AS (SELECT *, sum(k::INT) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM t
), n AS (SELECT trace_id, r + 1 AS r, count(DISTINCT page) AS n FROM g WHERE NOT k GROUP BY 1, 2)
SELECT trace_id, seq, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY trace_id ORDER BY seq) AS BIGINT) AS pages_written FROM g LEFT JOIN n USING (trace_id, r) WHERE k""",
    "pool_reset": f"""WITH t AS (SELECT *, event_id % 100 = 0 AS k FROM ({_OPS})
), a AS (SELECT trace_id, page, seq, row_number() OVER (PARTITION BY trace_id, page ORDER BY seq) = 1 AS m FROM t WHERE NOT k
), z AS (SELECT trace_id, coalesce(max(seq) FILTER (k), -1) AS z FROM t GROUP BY 1
), s AS (SELECT trace_id, count(*) FILTER (seq > z AND NOT m) AS h, count(*) FILTER (seq > z AND m) AS m FROM a JOIN z USING (trace_id) GROUP BY 1
), v AS (SELECT *, CASE WHEN h + m > 0 THEN h / (h + m) ELSE 0.0 END AS hit_rate FROM s)
SELECT trace_id, h AS cache_hits, m AS cache_misses, m AS pages_read, hit_rate, printf('Stats {{ hits: %d, misses: %d, evictions: 0, hit_rate: %.2f%% }}', h, m, 100.0 * hit_rate) AS summary FROM v""",
    "pool_contents_read": f"""SELECT trace_id, seq, op, page_id, version FROM (
  SELECT trace_id, seq, CASE WHEN w THEN 'write' ELSE 'read' END AS op, page AS page_id, last_value(CASE WHEN w THEN seq END IGNORE NULLS) OVER (PARTITION BY trace_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM ({_EVENTS})
) WHERE op = 'read'""",
    "pool_contents_stored": f"""WITH t AS (SELECT *, event_id % 50 = 0 AS k FROM ({_OPS})
), z AS (SELECT trace_id, max(seq) FILTER (k) AS z FROM t GROUP BY 1)
SELECT trace_id, page AS page_id, 'Data' AS page_type, max(seq) AS lsn, true AS checksum_ok FROM t JOIN z USING (trace_id) WHERE NOT k AND seq < z GROUP BY 1, 2""",
    "page_checksums": _CRC_SQL,
    "page_file": f"SELECT page_id, 'Data' AS page_type, doc_id AS lsn, true AS checksum_ok FROM ({_NUMBERED})",
    "page_file_size": f"SELECT count(*) AS page_count, count(*) * 4096 AS file_size, 'documents' AS file FROM ({_PARTS}) UNION ALL SELECT 0, 0, 'empty'",
    "page_file_reads": f"SELECT page_id, doc_id AS lsn, 'ok' AS state FROM ({_NUMBERED}), (SELECT count(*) AS n FROM ({_PARTS})) WHERE page_id IN (0, n // 2, n - 1)",
    "page_allocated": f"SELECT 'ok' AS state, count(*) AS n, count(*) - 1 AS last, 'Page(' || (count(*) - 1) || ')' AS shown FROM ({_PARTS}) UNION ALL SELECT 'zero', 3, count(*) + 2, 'Page(' || (count(*) + 2) || ')' FROM ({_PARTS})",
    "page_new_headers": f"SELECT doc_id, '0' || (CASE WHEN doc_id % 7 < 5 THEN doc_id % 7 ELSE 0 END) || repeat('00', 12) AS raw, CASE doc_id % 7 WHEN 1 THEN 'Data' WHEN 2 THEN 'BTreeInternal' WHEN 3 THEN 'BTreeLeaf' WHEN 4 THEN 'Free' ELSE 'Invalid' END AS page_type, CAST(0 AS BIGINT) AS checksum, CAST(0 AS BIGINT) AS lsn FROM documents",
    "page_ids": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 4294967295 ELSE doc_id END AS n FROM documents) SELECT doc_id, doc_id % 100 <> 0 AS valid, 'Page(' || CASE WHEN doc_id % 100 = 0 THEN 'INVALID' ELSE CAST(doc_id AS VARCHAR) END || ')' AS page, 'Frame(' || doc_id || ')' AS frame, 'I/O error: cause' AS Io, 'Page ' || n || ' not found' AS PageNotFound, 'No free frames available in buffer pool' AS NoFreeFrames, 'Invalid page ID: ' || n AS InvalidPageId, 'Buffer pool is full' AS BufferPoolFull, 'Page ' || n || ' is not pinned' AS PageNotPinned FROM d",
    "ext_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ext_session": "WITH s AS (SELECT user_id, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "ext_json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
}
