import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import SF, docs

from pagewright.llm import op10_flac as o
from pagewright.session import table


def stream(data):
    b = np.frombuffer(data, np.uint8)
    return o.encode(b, np.array([0, len(b)]))[0]


def samples(data):
    return o.decode_batch([data])[0]


R = np.random.default_rng(0)
TEXTS = [b"", b"x", b"a" * 500, b"hello world " * 20, bytes(range(256)) * 50, R.integers(0, 256, 10_000, dtype=np.uint8).tobytes(), ("é" * 3000).encode(), b"ab" * 10_000, bytes(np.cumsum(R.integers(-2, 3, 9300)).astype(np.int8).view(np.uint8)), b" " * 4608]


def test_round_trip_both_decoders():
    for t in TEXTS:
        s = stream(t)
        info, blocks = o.decode_stream(s)
        assert b"".join(b[0].astype(np.int8).tobytes() for _, b in blocks) == t
        got = samples(s)
        assert got[1][0].astype(np.int8).tobytes() == t
        assert got[2] == [i for i, _ in blocks]
        assert info["samples"] == len(t)
    many = o.decode_batch([stream(t) for t in TEXTS])
    assert [g[1][0].astype(np.int8).tobytes() for g in many] == TEXTS
    assert o.encode(np.frombuffer(b"".join(TEXTS), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in TEXTS])])) == [stream(t) for t in TEXTS]


def test_crc_vectors():
    assert o.crc8(b"123456789") == 0xF4
    b = np.frombuffer(b"123456789", np.uint8)
    assert o.crc16(b, np.array([0]), np.array([9]))[0] == 0xFEE8


class Out:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [(v >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, v, k):
        u = v << 1 if v >= 0 else (-v << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def foreign(chans, bits, mode, subframes, size, number=0):
    """A one-frame stream from subframes that write themselves."""
    out = Out()
    for f in subframes:
        f(out)
    head = bytes([0xFF, 0xF8, 7 << 4 | 0, mode << 4 | {8: 1, 16: 4}[bits] << 1]) + o._coded_number(number) + (size - 1).to_bytes(2, "big")
    frame = head + bytes([o.crc8(head)]) + out.bytes()
    raw = np.frombuffer(frame, np.uint8)
    frame += int(o.crc16(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    packed = 44100 << 44 | (len(chans) - 1) << 41 | (bits - 1) << 36 | size
    info = size.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(o.pcm_bytes(np.array(chans), bits)).digest()
    pad = bytes([1]) + (5).to_bytes(3, "big") + bytes(5)
    return b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x80 | pad[0]]) + pad[1:] + frame


def lpc(x, depth, coefs, shift, parts, wide=False, escape=False):
    def write(out):
        order = len(coefs)
        out.put(0, 1)
        out.put(31 + order, 6)
        out.put(0, 1)
        for v in x[:order]:
            out.put(v & ((1 << depth) - 1), depth)
        out.put(11, 4)
        out.put(shift, 5)
        for c in coefs:
            out.put(c & 0xFFF, 12)
        res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(x))]
        out.put(int(wide), 2)
        out.put(parts, 4)
        n, at = len(x) >> parts, 0
        for p in range(1 << parts):
            m = n - (order if p == 0 else 0)
            part, at = res[at : at + m], at + m
            if escape and p == 1:
                out.put(31 if wide else 15, 5 if wide else 4)
                out.put(20, 5)
                for v in part:
                    out.put(v & 0xFFFFF, 20)
                continue
            out.put(4 + p, 5 if wide else 4)
            for v in part:
                out.rice(v, 4 + p)

    return write


def verbatim(x, depth, wasted=0):
    def write(out):
        out.put(0, 1)
        out.put(1, 6)
        out.put(int(wasted > 0), 1)
        if wasted:
            out.bits += [0] * (wasted - 1) + [1]
        for v in x:
            out.put((v >> wasted) & ((1 << (depth - wasted)) - 1), depth - wasted)

    return write


def wave(n, seed, amp=900):
    r = random.Random(seed)
    return [int(amp * np.sin(i / 9)) + r.randrange(-20, 20) for i in range(n)]


def test_lpc_partitions_escapes_stereo_and_wasted_bits():
    a, b = wave(256, 1), wave(256, 2)
    for wide in (False, True):
        got = samples(foreign([a], 16, 0, [lpc(a, 16, [1800, -900, 60], 10, 2, wide, True)], 256))
        assert got[1][0].tolist() == a
    assert samples(foreign([a, b], 16, 1, [verbatim(a, 16), lpc(b, 16, [1900, -880], 10, 0)], 256))[1].tolist() == [a, b]
    side = [x - y for x, y in zip(a, b, strict=True)]
    mid = [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    assert samples(foreign([a, b], 16, 8, [verbatim(a, 16), verbatim(side, 17)], 256))[1].tolist() == [a, b]
    assert samples(foreign([a, b], 16, 9, [verbatim(side, 17), verbatim(b, 16)], 256))[1].tolist() == [a, b]
    assert samples(foreign([a, b], 16, 10, [verbatim(mid, 16), verbatim(side, 17)], 256))[1].tolist() == [a, b]
    w = [x << 3 for x in a]
    assert samples(foreign([w], 16, 0, [verbatim(w, 16, 3)], 256))[1][0].tolist() == w
    small = [x // 10 for x in a]
    assert samples(foreign([small], 8, 0, [lpc(small, 8, [1800, -900], 10, 1)], 256))[1][0].tolist() == small


def test_damage_is_found():
    s = bytearray(stream(b"some text that is long enough, really " * 400))
    for at in (45, 60, 3000, len(s) - 1):
        t = bytearray(s)
        t[at] ^= 0x10
        assert isinstance(samples(bytes(t)), o.FlacError), at
    for cut in (0, 3, 10, 50, len(s) - 1):
        assert isinstance(samples(bytes(s[:cut])), o.FlacError)


def expected(t):
    raw = (t or "").encode()
    return raw, raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


def check(rows, got):
    assert len(rows) == len(got)
    for (i, t), g in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, None))), strict=True):
        raw, pay = expected(t)
        assert (g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        m = stream(pay)
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    check(rows, o.op10_flac(spark, SF).collect())


def test_blocks_can_be_sought(spark):
    d = docs(spark, [(1, "abc def " * 2000), (2, None), (3, "x"), (3, "x")])
    media = o.encode_media(d)
    bad = spark.createDataFrame([(9, b"nonsense"), (10, None)], "doc_id long, media binary")
    rows = o.pcm_blocks(media.unionByName(bad)).orderBy("doc_id", "block").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.sample_offset for r in mine] == [0, 4608, 9216, 13824]
    want = ("abc def " * 2000).encode()
    assert all(bytes(r.pcm) == want[r.sample_offset : r.sample_offset + r.n_samples] for r in mine)
    assert [r.error for r in rows if r.doc_id == 9] == ["no fLaC marker"]
    assert not [r for r in rows if r.doc_id in (2, 10)]


@pytest.mark.parametrize("n", [1])
def test_edges(spark, n):
    d = docs(spark, [(1, None), (2, ""), (3, "é" * 200_000), (None, "q"), (4, "q")]).selectExpr("*", "1 AS media", "2 AS feature")
    got = o.media_rows(d).collect()
    assert sorted((r.payload_bytes for r in got)) == [192, 192, 192, 192, 400_128]
    assert len({(r.media_sha256, r.feature) for r in got}) == 3
    assert o.media_rows(d.limit(0)).count() == 0


def test_query_stores_streams(spark, monkeypatch):
    import hashlib

    stored, blocks = [], []
    keep, read = o.materialize, o.pcm_blocks
    monkeypatch.setattr(o, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    monkeypatch.setattr(o, "pcm_blocks", lambda *a: blocks.append(read(*a)) or blocks[-1])
    texts = ["é" * 7000, "", None, "abc " * 5000, "abc " * 5000]
    got = {(r.doc_id, r.n_bytes): r for r in o.media_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(stored) == len(blocks) == 1
    media = {r.doc_id: bytes(r.media) for r in stored[0].collect()}
    assert len(got) == len(media) == 5
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        pad = raw.ljust(max(1, -(-len(raw) // o.UNIT)) * o.UNIT)
        r = got[i, len(raw)]
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.payload_bytes == len(pad)
        assert r.media_sha256 == hashlib.sha256(media[i]).hexdigest() and r.media_bytes == len(media[i])
        signs = [c > 127 for c in pad]
        assert f"blocks={-(-len(pad) // o.BLOCK)};" in r.feature
        assert r.feature.endswith(f"crossings={sum(a != b for a, b in zip(signs, signs[1:]))}")


def test_linear_prediction_and_pieces(monkeypatch):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(1, 9))) for _ in range(r.choice([1, 40, 900, 3000]))).encode() for _ in range(30)]
    buf, off = o.padded(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    whole = o.encode(buf, off)
    kinds = set()
    for s in whole:
        info, at = o.stream_info(s)
        kinds.add(s[o.frame_header(s, at, info)["body"]])
    assert 64 + 2 * (o.LPC - 1) in kinds
    monkeypatch.setattr(o._runs, "__defaults__", (5000,))
    assert o.encode(buf, off) == whole
    for i, (s, (info, x, at)) in enumerate(zip(whole, o.decode_batch(whole), strict=True)):
        assert o.pcm_bytes(x, 8) == buf[off[i] : off[i + 1]].tobytes()
        slow, blocks = o.decode_stream(s)
        assert [b[0] for b in blocks] == at and slow == info
        assert (np.concatenate([b for _, b in blocks], axis=1) == x).all()
    bad = bytearray(whole[3])
    bad[len(bad) // 2] ^= 4
    assert isinstance(o.decode_batch([bytes(bad)])[0], o.FlacError)
