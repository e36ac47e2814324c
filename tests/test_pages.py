import zlib

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.plans.traces import document_pages
from pagewright.sources import pagefile


def page(kind=0, checksum=0, lsn=0, at=()):
    b = bytearray(4096)
    b[0] = kind
    b[1:5] = checksum.to_bytes(4, "little")
    b[5:13] = lsn.to_bytes(8, "little")
    for i, v in at:
        b[i] = v
    return bytes(b)


def crc(b):
    return zlib.crc32(b[:1] + bytes(4) + b[5:])


def one(spark, data, *cols):
    return spark.createDataFrame([(data,)], "data binary").select(*cols).first()


def test_constants():
    assert (P.PAGE_SIZE, P.MAX_PAGES, P.MAX_FILE_BYTES) == (4096, 1 << 32, 1 << 44)


@pytest.mark.parametrize(("kind", "checksum", "lsn"), [(3, 0xDEADBEEF, 0x123456789ABCDEF0), (1, 0x04030201, 0x0807060504030201), (4, 0, (1 << 63) + 5), (2, (1 << 32) - 1, (1 << 64) - 1)])
def test_header_round_trip(spark, kind, checksum, lsn):
    data = page(kind, checksum, lsn)
    h = one(spark, data, P.header("data").alias("h")).h
    assert (h.page_type, h.checksum, int(h.lsn)) == (P.PAGE_TYPES[kind], checksum, lsn)
    back = one(spark, page(at=[(100, 7)]), P.set_header("data", F.lit(h.page_type), F.lit(checksum), F.lit(str(lsn)).cast("decimal(20,0)")).alias("b")).b
    assert bytes(back) == page(kind, checksum, lsn, [(100, 7)])


def test_type_codes(spark):
    got = [one(spark, page(k), P.header("data")["page_type"].alias("t")).t for k in (0, 1, 2, 3, 4, 5, 255)]
    assert got == ["Invalid", "Data", "BTreeInternal", "BTreeLeaf", "Free", "Invalid", "Invalid"]


def test_short_header_is_an_error_and_null_is_null(spark):
    with pytest.raises(PySparkException):
        one(spark, b"abc", P.header("data")["lsn"])
    assert one(spark, None, P.header("data")["page_type"].alias("t")).t is None


def test_checksums(spark):
    a, b = page(at=[(100, 0xAB), (1000, 0xCD)]), page(at=[(500, 0xFE)])
    for x in (a, b, page(1, 0xFFFFFFFF, 9)):
        assert one(spark, x, P.computed_checksum("data").alias("c")).c == crc(x)
    assert crc(page(1, 5)) == crc(page(1, 0xFFFFFFFF))
    good = bytes(one(spark, a, P.update_checksum("data").alias("d")).d)
    assert int.from_bytes(good[1:5], "little") == crc(a)
    assert one(spark, good, P.verify_checksum("data").alias("v")).v
    bad = bytearray(good)
    bad[100] = 0xFF
    assert not one(spark, bytes(bad), P.verify_checksum("data").alias("v")).v


def test_zero_page_is_a_class_of_its_own(spark):
    z = bytes(4096)
    r = one(spark, z, P.computed_checksum("data").alias("c"), P.verify_checksum("data").alias("v"), P.page_class("data").alias("k"), (F.col("data") == P.zero_page()).alias("same"))
    assert (r.c, r.v, r.k, r.same) == (0xC71C0011, False, "zero", True)


def test_shown(spark):
    r = spark.range(1).select(P.page_id_text(F.lit(5)).alias("a"), P.page_id_text(P.page_id(F.lit(P.INVALID_PAGE_ID))).alias("b"), P.frame_id_text(F.lit(3)).alias("c"), P.stats_text(F.lit(80), F.lit(20), F.lit(1)).alias("d"), P.hit_rate(F.lit(0), F.lit(0)).alias("e"), P.hit_rate(F.lit(7), F.lit(3)).alias("f"), P.outcome_message(F.lit("PageNotFound"), F.lit(5)).alias("g"), P.outcome_message(F.lit("ok"), F.lit(5)).alias("h")).first()
    assert tuple(r) == ("Page(5)", "Page(INVALID)", "Frame(3)", "Stats { hits: 80, misses: 20, evictions: 1, hit_rate: 80.00% }", 0.0, 0.7, "Page 5 not found", None)


def test_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.db")
    made = spark.range(10).select(F.col("id").alias("page_id"), F.concat(F.unhex(F.lpad(F.hex("id"), 2, "0")), F.substring(P.zero_page(), 2, 4095)).alias("data"))
    pagefile.save(made, path)
    back = pagefile.open_pages(spark, path, pagesPerPartition=3)
    assert back.rdd.getNumPartitions() == 4
    assert [(r.page_id, r.data[0], len(r.data)) for r in back.orderBy("page_id").collect()] == [(i, i, 4096) for i in range(10)]
    assert tuple(pagefile.size(back).first()) == (10, 40960)
    assert [r.page_id for r in pagefile.open_pages(spark, path, minPage=3, maxPage=4).orderBy("page_id").collect()] == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["a.db"]
    with pytest.raises(PySparkException):
        pagefile.save(made, path)
    pagefile.save(made.limit(0), path, overwrite=True)
    assert pagefile.page_count(path) == 0


@pytest.mark.parametrize(("size", "pages"), [(0, 0), (100, 0), (4096, 1), (5 * 4096 + 100, 5)])
def test_partial_tail_is_ignored(spark, tmp_path, size, pages):
    path = tmp_path / "t.db"
    path.write_bytes(b"\x01" * size)
    assert pagefile.open_pages(spark, str(path)).count() == pages
    assert pagefile.read_binary(spark, str(path)).count() == pages


def test_open_and_create(spark, tmp_path):
    path = str(tmp_path / "n.db")
    with pytest.raises(FileNotFoundError):
        pagefile.open_pages(spark, path)
    assert pagefile.create(spark, path).count() == 0
    with pytest.raises((PySparkException, FileExistsError)):
        pagefile.create(spark, path)
    assert pagefile.open_or_create(spark, path).count() == 0


def test_gaps_and_doubles_are_refused(spark, tmp_path):
    for ids in ([0, 2], [0, 0], [1]):
        d = spark.createDataFrame([(i, bytes(4096)) for i in ids], pagefile.SCHEMA)
        with pytest.raises(PySparkException):
            pagefile.save(d, str(tmp_path / "g.db"))


def test_tasks_write_in_place_in_any_order_and_again(tmp_path):
    path = str(tmp_path / "w.db")

    def batch(*ids):
        return pa.RecordBatch.from_pydict({"page_id": ids, "data": [bytes([i]) * 4096 for i in ids]})

    w = pagefile.PageFile({"path": path}).writer(None, False)
    late, early, none = w.write(iter([batch(3), batch(4, 5).slice(0, 2)])), w.write(iter([batch(9, 0, 1, 2).slice(1)])), w.write(iter([]))
    again = w.write(iter([batch(3, 4, 5)]))
    w.write(iter([batch(6, 7)]))  # an attempt that wasn't taken
    assert not pagefile.exists(path)
    w.commit([late, none, early])
    assert open(path, "rb").read() == b"".join(bytes([i]) * 4096 for i in range(6))
    assert (again.first, again.last) == (late.first, late.last)
    assert [x.name for x in tmp_path.iterdir()] == ["w.db"]
    w = pagefile.PageFile({"path": path}).writer(None, True)
    w.abort([w.write(iter([batch(0)])), None])
    assert [x.name for x in tmp_path.iterdir()] == ["w.db"]


def test_joined_on_stores_without_places(tmp_path):
    path = str(tmp_path / "j.db")
    w = pagefile.PageFile({"path": path}).writer(None, False)
    w.placed = False
    parts = [w.write(iter([pa.RecordBatch.from_pydict({"page_id": [i], "data": [bytes([i]) * 4096]})])) for i in (1, 0)]
    w.commit(parts)
    assert open(path, "rb").read() == bytes(4096) + b"\x01" * 4096
    assert [x.name for x in tmp_path.iterdir()] == ["j.db"]


def test_store_operations(spark):
    s = pagefile.allocate(pagefile.empty(spark), 2)
    assert sorted(r.page_id for r in s.collect()) == [0, 1]
    new = spark.createDataFrame([(1, b"\x07" * 4096), (2, b"\x08" * 4096)], pagefile.SCHEMA)
    w = pagefile.write_pages(s, new)
    assert {r.page_id: r.data[0] for r in w.collect()} == {0: 0, 1: 7}
    assert [tuple(r) for r in pagefile.missing(s, new.select("page_id")).collect()] == [(2, "PageNotFound")]
    assert pagefile.read_page(w, 2).count() == 0
    assert pagefile.read_page(w, 1).first().data[4095] == 7


def test_document_pages(spark):
    docs = spark.createDataFrame([(1, "é" * 5000), (2, None), (3, "")], "doc_id long, text string")
    got = document_pages(docs).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.part) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    raw = b"".join(bytes(r.data[13:]) for r in got[:3])
    assert raw == ("é" * 5000).encode() + bytes(len(raw) - 10000)
    for r in got:
        assert len(r.data) == 4096
        assert int.from_bytes(r.data[1:5], "little") == crc(bytes(r.data))
        assert int.from_bytes(r.data[5:13], "little") == r.doc_id


def test_messages_take_bare_numbers(spark):
    r = spark.range(1).select(*(P.outcome_message(F.lit(k), F.lit(42), F.lit("disk on fire")).alias(k) for k in P.MESSAGES), P.outcome_message(F.lit("PageNotFound"), F.lit(None)).alias("none")).first()
    assert tuple(r) == ("I/O error: disk on fire", "Page 42 not found", "No free frames available in buffer pool", "Invalid page ID: 42", "Buffer pool is full", "Page 42 is not pinned", "Page 4294967295 not found")


def test_point_read_and_numbering(spark, tmp_path):
    path = str(tmp_path / "b.db")
    d = spark.range(500).selectExpr("id * 7 AS k").repartition(7).withColumn("data", F.concat(F.unhex(F.lpad(F.hex("k"), 8, "0")), F.substring(P.zero_page(), 5, 4092)))
    made = pagefile.number(d, "k")
    pagefile.save(made.select("page_id", "data"), path)
    assert [int.from_bytes(r.data[:4], "big") for r in pagefile.open_pages(spark, path).orderBy("page_id").collect()] == [7 * i for i in range(500)]
    one_ = pagefile.page_at(spark, path, 123)
    assert one_.rdd.getNumPartitions() == 1
    assert [(r.page_id, int.from_bytes(r.data[:4], "big")) for r in one_.collect()] == [(123, 861)]
    assert pagefile.page_at(spark, path, 500).count() == 0
    assert pagefile.page_at(spark, path, -1).count() == 0


def test_pushed_filters(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    path = tmp_path / "c.db"
    path.write_bytes(bytes(4096 * 10))
    r = pagefile.PageFile({"path": str(path), "pushfilters": "true"}).reader(None)
    rest = list(r.pushFilters([GreaterThanOrEqual(("page_id",), 3), LessThan(("page_id",), 6), StringContains(("data",), "x")]))
    assert rest == [StringContains(("data",), "x")]
    assert [(p.first, p.last) for p in r.partitions()] == [(3, 6)]
    r = pagefile.PageFile({"path": str(path), "pushfilters": "true"}).reader(None)
    assert list(r.pushFilters([EqualTo(("page_id",), 9)])) == []
    assert [(p.first, p.last) for p in r.partitions()] == [(9, 10)]


def test_filter_pushdown_by_session(spark, tmp_path):
    path = tmp_path / "d.db"
    path.write_bytes(bytes(4096 * 40))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = pagefile.open_pages(spark, str(path), pagesPerPartition=1).where("page_id >= 7 and page_id < 10")
        assert [r.page_id for r in got.orderBy("page_id").collect()] == [7, 8, 9]
        assert got.rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
