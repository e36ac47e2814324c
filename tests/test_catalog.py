import math
from pathlib import Path

import duckdb
import pytest

from pagewright.operators.pool import Pool
from pagewright.plans import catalog
from pagewright.session import table

SF = "/root/testdata/sf0.001"


def plain(rows, cols):
    def v(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else str(x) if not isinstance(x, int | float | bool | str) else x

    return sorted((tuple(v(r[c]) for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    rel = con.sql(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert plain(df.collect(), cols) == plain(want, cols)


@pytest.mark.parametrize(("name", "leak"), [("pool_missing_pages", True), ("pool_missing_pages_kept", False)])
def test_missing_pages(spark, name, leak):
    want: dict = {}
    pools: dict = {}
    for r in table(spark, SF, "events").orderBy("event_id").collect():
        pool = pools.setdefault(r.event_type, Pool(catalog.POOL, 60, leak))
        out = pool.apply("write" if r.event_id % 4 == 0 else "read", r.user_id % 64)[0]
        want[r.event_type, out] = want.get((r.event_type, out), 0) + 1
    assert {(r.trace_id, r.outcome): r.n for r in catalog.QUERIES[name](spark, SF).collect()} == want


def test_replacer(spark):
    from pagewright.operators.replacer import Fifo

    want, fifos = {}, {}
    for r in table(spark, SF, "events").orderBy("event_id").collect():
        f = fifos.setdefault(r.event_type, Fifo())
        v = f.apply("evict" if r.event_id % 5 == 0 else "access" if r.event_id % 2 == 0 else "evictable", r.user_id % 32)
        if r.event_id % 5 == 0:
            a, b, c = want.get(r.event_type, (0, 0, 0))
            want[r.event_type] = (a + 1, b + (v is not None), c + (v or 0))
    assert {r.trace_id: (r.asked, r.evicted, r.frame_sum or 0) for r in catalog.QUERIES["pool_replacer"](spark, SF).collect()} == want


def test_page_checksums(spark):
    import zlib

    want = {}
    for r in table(spark, SF, "documents").collect():
        raw = (r.text or "").encode()
        for part in range(max(1, -(-len(raw) // 4083))):
            body = raw[part * 4083 : (part + 1) * 4083]
            want[r.doc_id, part] = zlib.crc32(b"\x01" + bytes(4) + r.doc_id.to_bytes(8, "little") + body + bytes(4083 - len(body)))
    assert {(r.doc_id, r.part): r.checksum for r in catalog.QUERIES["page_checksums"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_page_store_of_all_nations(spark):
    rows = catalog.QUERIES["page_store_nation"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.n_nationkey for r in table(spark, SF, "nation").collect())
    assert sum(r.state == "PageNotFound" for r in rows) == len(rows) - 10
