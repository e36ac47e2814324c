"""Page and header functions as Columns.

A page is 4,096 bytes. Its 13-byte header, little-endian, holds the page type (1 byte), the checksum (4, CRC-32 of the page with these four
bytes taken as zero) and the log sequence number (8, unsigned). Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
PAGE_SIZE = 4096
HEADER_SIZE = 13
MAX_PAGES = 1 << 32
MAX_FILE_BYTES = MAX_PAGES * PAGE_SIZE
INVALID_PAGE_ID = (1 << 32) - 1
PAGE_TYPES = ("Invalid", "Data", "BTreeInternal", "BTreeLeaf", "Free")

PAYLOAD_SIZE = PAGE_SIZE - HEADER_SIZE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slice(data: Column, start: int, size: int | None = None) -> Column:
    """Bytes from start (from 0)."""
    return F.substring(data, start + 1, PAGE_SIZE if size is None else size)


def zero_bytes(n: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def zero_page() -> Column:
    return zero_bytes(PAGE_SIZE)


def _number(data: Column, start: int, size: int) -> Column:
    """A little-endian unsigned number as decimal text."""
    return F.conv(F.concat(*(F.hex(_slice(data, start + i, 1)) for i in reversed(range(size)))), 16, 10)


def _bytes(number: Column, size: int) -> Column:
    """A number's little-endian bytes; its value modulo 2^(8 size)."""
    digits = F.lpad(F.conv(number.cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def page_type_name(code: Column | str) -> Column:
    """Name of a type code; any code that isn't defined is Invalid."""
    out = F.lit(PAGE_TYPES[0])
    for i, name in enumerate(PAGE_TYPES[1:], 1):
        out = F.when(_col(code) == i, name).otherwise(out)
    return out


def page_type_code(name: Column | str) -> Column:
    out = F.lit(0)
    for i, n in enumerate(PAGE_TYPES[1:], 1):
        out = F.when(_col(name) == n, i).otherwise(out)
    return out


def header(data: Column | str) -> Column:
    """struct(page_type, checksum, lsn). An error for data of fewer than 13 bytes; null for null."""
    d = _col(data)
    whole = F.when(F.length(d) < HEADER_SIZE, F.raise_error(F.lit(f"a header has {HEADER_SIZE} bytes"))).otherwise(d)
    kind = F.conv(F.hex(_slice(whole, 0, 1)), 16, 10).cast("int")
    return F.struct(F.when(d.isNotNull(), page_type_name(kind)).alias("page_type"), _number(whole, 1, 4).cast("long").alias("checksum"), _number(whole, 5, 8).cast("decimal(20,0)").alias("lsn"))


def new_header(page_type: Column | str) -> Column:
    """A header with checksum and log sequence number 0."""
    return F.struct(_col(page_type).alias("page_type"), F.lit(0).cast("long").alias("checksum"), F.lit(0).cast("decimal(20,0)").alias("lsn"))


def header_bytes(page_type: Column | str, checksum: Column | str, lsn: Column | str) -> Column:
    return F.concat(_bytes(page_type_code(page_type), 1), _bytes(_col(checksum), 4), _bytes(_col(lsn), 8))


def set_header(data: Column | str, page_type: Column | str, checksum: Column | str, lsn: Column | str) -> Column:
    return F.concat(header_bytes(page_type, checksum, lsn), _slice(_col(data), HEADER_SIZE))


def computed_checksum(data: Column | str) -> Column:
    d = _col(data)
    return F.crc32(F.concat(_slice(d, 0, 1), zero_bytes(4), _slice(d, 5)))


def update_checksum(data: Column | str) -> Column:
    d = _col(data)
    return F.concat(_slice(d, 0, 1), _bytes(computed_checksum(d), 4), _slice(d, 5))


def verify_checksum(data: Column | str) -> Column:
    return _number(_col(data), 1, 4).cast("long") == computed_checksum(data)


def page_class(data: Column | str) -> Column:
    """zero (all zero bytes, whose checksum doesn't verify), ok or corrupt."""
    return F.when(_col(data) == zero_page(), "zero").when(verify_checksum(data), "ok").otherwise("corrupt")


def page_id(value: Column | str) -> Column:
    """A page number of a file; the sentinel becomes null."""
    v = _col(value).cast("long")
    return F.when((v >= 0) & (v < INVALID_PAGE_ID), v)


def page_id_text(value: Column | str) -> Column:
    return F.concat(F.lit("Page("), F.coalesce(_col(value).cast("string"), F.lit("INVALID")), F.lit(")"))


def frame_id_text(value: Column | str) -> Column:
    return F.concat(F.lit("Frame("), _col(value).cast("string"), F.lit(")"))


def hit_rate(hits: Column | str, misses: Column | str) -> Column:
    """hits / (hits + misses); 0 without accesses."""
    h, m = _col(hits), _col(misses)
    return F.when(h + m > 0, h / (h + m)).otherwise(F.lit(0.0))


def stats_text(hits: Column | str, misses: Column | str, evictions: Column | str) -> Column:
    return F.format_string("Stats { hits: %d, misses: %d, evictions: %d, hit_rate: %.2f%% }", _col(hits), _col(misses), _col(evictions), hit_rate(hits, misses) * 100)


#: What an outcome says; {page} stands for the page's number, {cause} for what the system said.
MESSAGES = {
    "Io": "I/O error: {cause}",
    "PageNotFound": "Page {page} not found",
    "NoFreeFrames": "No free frames available in buffer pool",
    "InvalidPageId": "Invalid page ID: {page}",
    "BufferPoolFull": "Buffer pool is full",
    "PageNotPinned": "Page {page} is not pinned",
}


def outcome_message(outcome: Column | str, page: Column | str, cause: Column | str | None = None) -> Column:
    """Text of an outcome, with the page's bare number (the sentinel's for no page); null for ok. cause: of an Io outcome, what it comes from."""
    number = F.coalesce(_col(page).cast("string"), F.lit(str(INVALID_PAGE_ID)))
    out = F.lit(None).cast("string")
    for k, text in MESSAGES.items():
        told = F.replace(F.lit(text), F.lit("{page}"), number)
        if cause is not None:
            told = F.replace(told, F.lit("{cause}"), _col(cause))
        out = F.when(_col(outcome) == k, told).otherwise(out)
    return out
