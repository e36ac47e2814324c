import random
import subprocess
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from helpers import SF, docs
from tokenizers import Tokenizer

from pagewright.llm import op8_token_store as o
from pagewright.session import table

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids(tok, text):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, o.END_ID], "<u4")


def test_whole_table(spark, tok):
    got = {r.doc_id: r for r in o.op8_token_store(spark, SF).collect()}
    at = 0
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    assert len(got) == len(rows)
    for i, t in rows:
        e = ids(tok, t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(e), zlib.crc32(e.tobytes()))
        at += len(e)


def test_pieces_encode_like_whole_texts(tok):
    r = random.Random(3)
    parts = ["a", "don't", "It's", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "É", "12", "3,4", ".", "!!", "***", " ", " ", "᠎", "\x1c", "\x85", "日本", "word,", "(x)", "<|endoftext|>", "'", "’s", "_", "-", "🙂", "\r\n"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(3000)), *(" ".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(3000))]
    c = o.WordCoder(PATH)
    for i in range(0, len(texts), 300):
        for t, g in zip(texts[i : i + 300], c.encode(texts[i : i + 300]), strict=True):
            assert np.frombuffer(g, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_cache_stays_bounded(tok, monkeypatch):
    monkeypatch.setattr(o, "CACHE_WORDS", 50)
    c = o.WordCoder(PATH)
    for i in range(20):
        t = " ".join(f"w{i}x{k}" for k in range(30))
        assert np.frombuffer(c.encode([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(c.first) + len(c.next) <= 110


def test_perfect_hash():
    h = o.scramble(np.arange(5000, dtype=np.uint64))
    m = o.PerfectHash.build(h)
    assert sorted(m.slots(h).tolist()) == list(range(5000))
    back, _ = o.PerfectHash.unpack(m.pack())
    assert (back.slots(h) == m.slots(h)).all()
    assert len(m.bits) / 5000 < 4.5  # bits a key
    assert o.PerfectHash.build(h[:0]).slots(h[:3]).tolist() == [-1] * 3


def test_keyed_access(spark, tok):
    rows = [(i * 7, f"text number {i} of many") for i in range(300)]
    store = o.write_store(docs(spark, rows), PATH)
    keys = spark.createDataFrame([(14, 0), (15, 0), (700, 0), (14, 1), (None, 0)], "doc_id long, copy long")
    found = o.lookup(store, keys)
    got = {r.doc_id: bytes(r.ids) for r in o.read_ids(store, found, "ids binary", lambda x: (x.tobytes(),)).collect()}
    assert got == {k: ids(tok, f"text number {k // 7} of many").tobytes() for k in (14, 700)}


def test_edges(spark, tok):
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "n"), (1, None), (-3, ""), (9, "long " * 100_000)]
    d = docs(spark, rows).selectExpr("*", "1 AS shard", "2 AS copy", "'x' AS first")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in o.token_rows(d).collect())
    assert [g[1] for g in got] == [None, -3, 1, 5, 5, 5, 9]
    assert sorted(g[3] for g in got) == sorted(zlib.crc32(ids(tok, t).tobytes()) for _, t in rows)
    assert got[0][0] == 0
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert o.token_rows(d.limit(0)).count() == 0


def test_long_texts_are_cut_where_ids_are_cut(tok, monkeypatch):
    monkeypatch.setattr(o, "CHUNK", 40)
    r = random.Random(5)
    parts = ["a", "don't", " ", "  ", "\n", "\t", "é,", "12", "!!", "word", "(x)", "long"]
    texts = ["", *(r.choice(["", " "]).join(r.choice(parts) for _ in range(r.randint(1, 200))) for _ in range(300)), " ".join(["word"] * 500), "x" * 500]
    c, got, n = o.WordCoder(PATH), [[] for _ in texts], 0
    for part, owner, last in o._parts(texts):
        ids, size = c.encode_all(part)
        n += sum(last)
        for i, x in zip(owner, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            got[i] += x.tolist()
    assert n == len(texts)
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_copies_over_shards(spark):
    """A third of all rows have no id and a third the same one: copy numbers go on from shard to shard, and every key is found."""
    rows = [((None, 7, i)[i % 3], f"text {i % 50}") for i in range(1200)]
    store = o.write_store(docs(spark, rows).repartition(5), PATH)
    entries = store.entries.collect()
    by_id = {}
    for r in sorted(entries, key=lambda r: (r.shard, r.first)):
        by_id.setdefault(r.doc_id, []).append(r.copy)
    assert {k: len(v) for k, v in by_id.items()}[None] == 400
    assert all(v == list(range(len(v))) for v in by_id.values())
    found = o.lookup(store, store.entries.select("doc_id", "copy")).collect()
    assert sorted(found, key=repr) == sorted(((r.doc_id, r.copy, r.shard, r.first, r.n_tokens) for r in entries), key=repr)


def test_cache_is_released_when_all_texts_are_encoded(tmp_path):
    o._coder(PATH, False).encode(["some words"])
    assert o._CODERS
    o._index_writer(str(tmp_path))((0,), pd.DataFrame({"doc_id": [1, 2], "copy": [0, 0], "shard": [0, 0], "first": [0, 3], "n_tokens": [3, 4]}))
    assert not o._CODERS


_HOLES = """
import ctypes, re
from pathlib import Path
from pagewright.llm import textbatch as t

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

t.claim("one")
libc = ctypes.CDLL(None)
libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
held = [libc.malloc(100_000) for _ in range(2000)]
for p in held:
    ctypes.memset(p, 1, 100_000)
for p in held[:-1]:  # the last one keeps the allocator from giving back what lies before it
    libc.free(p)
before = mb()
t.claim("two")
print(before - mb())
"""


def test_freed_memory_goes_back_between_operators():
    got = subprocess.run([sys.executable, "-c", _HOLES], capture_output=True, text=True, timeout=60, check=True)
    assert float(got.stdout.split()[-1]) > 150
