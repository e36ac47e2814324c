import random

import pytest

from pagewright.operators.contents import READS, page_reads, stored_pages, stored_versions

SCHEMA = "trace_id string, seq long, op string, page_id long"


class Plain:
    """A pool whose frames hold their pages' bytes (here the seq of the write) beside a file, in the simplest way."""

    def __init__(self, size, pages):
        self.size, self.file, self.frames, self.kept = size, dict.fromkeys(range(pages)), {}, set()

    def fetch(self, page):
        if page not in self.frames:
            if len(self.frames) == self.size:
                out = next((p for p, f in self.frames.items() if not f["pins"]), None)
                if out is None:
                    return False
                self.back(out)
                del self.frames[out]
            self.frames[page] = {"data": self.file[page], "dirty": False, "pins": 0}
        self.frames[page]["pins"] += 1
        return True

    def back(self, page):
        f = self.frames[page]
        if f["dirty"]:
            self.file[page], f["dirty"] = f["data"], False
            self.kept.add(page)

    def run(self, rows):
        seen = []
        for seq, op, page in rows:
            f = self.frames.get(page)
            if op in ("read", "fetch_read", "fetch_write", "write"):
                if not self.fetch(page):
                    continue
                f = self.frames[page]
                if op in READS:
                    seen.append((seq, page, f["data"]))
                if op == "write":
                    f["data"], f["dirty"] = seq, True
                if op in ("read", "write"):
                    f["pins"] -= 1
            elif op.startswith("drop") and f and f["pins"]:
                f["pins"] -= 1
                if op == "drop_write":
                    f["data"], f["dirty"] = seq, True
            elif op == "flush" and f:
                self.back(page)
            elif op == "flush_all":
                for p in self.frames:
                    self.back(p)
            elif op == "delete" and f and not f["pins"]:
                del self.frames[page]
        return seen


@pytest.mark.parametrize("size", [1, 3, 8])
def test_against_frames_with_bytes(spark, size):
    rng = random.Random(size)
    ops = ["read", "read", "write", "write", "fetch_read", "fetch_write", "drop_read", "drop_write", "drop_write", "flush", "delete", "flush_all"]
    traces = {t: [(i, rng.choice(ops), rng.randrange(10)) for i in range(600)] for t in ("a", "b", None)}
    df = spark.createDataFrame([(t, *r) for t, rows in traces.items() for r in rows], SCHEMA).repartition(5)
    payloads = df.selectExpr("trace_id", "seq", "cast(cast(seq * 2 as string) as binary) AS data")
    reads, stored = page_reads(df, size, 10).collect(), stored_pages(df, payloads, size, 10).collect()
    backs = 0
    for t, rows in traces.items():
        plain = Plain(size, 10)
        assert sorted((r.seq, r.page_id, r.version) for r in reads if r.trace_id == t) == sorted(plain.run(rows))
        mine = [r for r in stored if r.trace_id == t]
        assert {r.page_id: r.version for r in mine} == {p: plain.file[p] for p in plain.kept}
        assert all(r.data == str(r.version * 2).encode() for r in mine)
        backs += len(mine)
    assert backs > 10


def test_pages_never_seen_without_their_write(spark):
    """A write survives the eviction of its page; one that is deleted in its frame doesn't."""
    rows = [("t", 1, "write", 0), ("t", 2, "read", 1), ("t", 3, "read", 0), ("t", 4, "write", 0), ("t", 5, "delete", 0), ("t", 6, "read", 0), ("t", 7, "read", 99), ("t", 8, "read", None)]
    got = page_reads(spark.createDataFrame(rows, SCHEMA), 1, 2).collect()
    assert sorted((r.seq, r.version) for r in got) == [(2, None), (3, 1), (6, 1)]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert page_reads(empty, 2, 4).count() == stored_versions(empty, 2, 4).count() == 0
    odd = spark.createDataFrame([("t", None, "write", 0, "x"), ("t", 1, "read", 0, "y"), ("t", 2, "flush_all", None, None), ("t", 2, "nonsense", 1, None), ("t", 3, None, None, None)], SCHEMA + ", version string")
    assert [(r.seq, r.version) for r in page_reads(odd, 2, 4).collect()] == [(1, None)]
    assert [(r.page_id, r.version) for r in stored_versions(odd, 2, 4).collect()] == [(0, None)]
    lost = stored_pages(spark.createDataFrame([("t", 1, "write", 0), ("t", 2, "flush", 0)], SCHEMA), spark.createDataFrame([("u", 1, b"x")], "trace_id string, seq long, data binary"), 2, 4).collect()
    assert [(r.page_id, r.version, r.data) for r in lost] == [(0, 1, None)]
