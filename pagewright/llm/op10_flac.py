"""FLAC media columns: decode streams to PCM blocks with sample offsets, verify frame checksums, and encode 8-bit mono streams.

The format is that of RFC 9639. Decoding handles constant, verbatim, fixed-predictor and LPC subframes, Rice partitions of either
parameter width with escape codes, wasted bits, and the four stereo modes; every frame's CRC-8 and CRC-16 are verified, and the
stream's MD5 against the decoded samples. Two paths give the same result: a bit reader that decodes any frame, and a vectorised one
for mono 8-bit frames with one Rice partition, which decodes many frames at once (frames are found by their
sync code, CRC-8 and running number; should one not end exactly where the next begins, its stream goes to the bit reader).

Encoding takes bytes as signed 8-bit samples, in blocks of 4,608, and picks for each block among constant, verbatim, fixed predictors of
order 0 to 2 and a linear predictor of order 4 (autocorrelation, Levinson-Durbin, 12-bit coefficients), with the best of three Rice
parameters. It is deterministic: equal bytes, equal streams.

Memory: frames of about 1 MB of samples are coded or decoded at a time, whatever a partition holds and however long a text is; beside them a text is held
a few times over (text, payload, stream, samples), so one of 100 MB takes under 1 GB. Nothing is shuffled.
The query writes its streams to the shared folder and describes the PCM blocks read back from there.

Null and empty texts count as empty payloads (the query pads them to 192 spaces). Null media give no blocks. A stream that is
damaged gives error texts in `error`, not a failed task. Repeated rows are handled each for itself; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.textbatch import pieces
from pagewright.session import materialize, table

BLOCK, RATE, UNIT = 4608, 8000, 192
PIECE = 1 << 20
#: Order, bits of a coefficient, and bits ahead of the residuals, of the encoder's linear predictor.
LPC, PRECISION = 4, 12
LPC_BITS = 4 + 5 + LPC * PRECISION

# ---------------------------------------------------------------- checksums


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if width == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


@functools.cache
def _crc16_after(log2: int) -> np.ndarray:
    """Row j: what each byte value adds to the CRC-16 of a message in which j bytes follow it."""
    out = np.empty((1 << log2, 256), np.uint16)
    out[0] = CRC16
    for j in range(1, len(out)):
        t = out[j - 1]
        out[j] = (t << 8) ^ CRC16[t >> 8]
    return out.reshape(-1)


def crc16(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span (not empty) of a buffer."""
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint16)
    add = _crc16_after(max(13, int(n.max()).bit_length()))
    first = np.cumsum(n) - n
    i = np.arange(int(n.sum()), dtype=np.int32)
    bytes_ = buf[i + np.repeat((start - first).astype(np.int32), n)]
    row = np.repeat((first + n - 1).astype(np.int32), n) - i
    row <<= 8
    row |= bytes_
    return np.bitwise_xor.reduceat(add[row], first)


# ---------------------------------------------------------------- encoding


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    lead = (0xFF << (room + 1)) & 0xFF
    return bytes([lead | n, *reversed(tail)])


@functools.lru_cache(100_000)
def _frame_header(number: int, size: int) -> bytes:
    codes = {192: 1} | {576 << i: 2 + i for i in range(4)} | {256 << i: 8 + i for i in range(8)}
    code, more = (codes[size], b"") if size in codes else (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + _coded_number(number) + more
    return head + bytes([crc8(head)])


def _stream_header(samples: int, least: int, most: int, md5: bytes) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info


def encode(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One stream for each document's bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + number * BLOCK
    size = np.minimum(BLOCK, offsets[doc + 1] - start)
    body, length = _all_frames(buf, start, size, number)
    at = np.cumsum(length) - length
    ends = np.cumsum(per)
    out = []
    for d in range(len(sizes)):
        md5 = hashlib.md5(buf[offsets[d] : offsets[d + 1]]).digest()
        a, z = ends[d] - per[d], ends[d]
        if a == z:
            out.append(_stream_header(0, 0, 0, md5))
            continue
        lens = length[a:z]
        out.append(_stream_header(int(sizes[d]), int(lens.min()), int(lens.max()), md5) + body[at[a] : at[z - 1] + length[z - 1]].tobytes())
    return out


def _runs(size: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of sizes whose sum is at most so much, or one size."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + most, "right")))
        yield a, z
        a = z


def _all_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' bytes in a row, and each frame's length; about PIECE samples at a time."""
    parts, lengths = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for a, z in _runs(size):
        out, at, length = _frames(buf[start[a] : start[z - 1] + size[z - 1]], start[a:z] - start[a], size[a:z], number[a:z])
        parts.append(out[: at[-1] + length[-1]])
        lengths.append(length)
    return np.concatenate(parts), np.concatenate(lengths)


def _predict(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each frame's coefficients (LPC rows) and shift, and the residuals of all samples; those of a frame's first LPC samples mean nothing."""
    r = []
    for k in range(LPC + 1):
        p = np.zeros(len(x), np.int32)
        np.multiply(x[k:], x[: len(x) - k], out=p[k:])
        for j in range(k):
            p[first[size > j] + j] = 0
        r.append(np.add.reduceat(p, first, dtype=np.int64).astype(np.float64))
    a, err = np.zeros((LPC, len(first))), r[0] * (1 + 1e-6) + 1
    for i in range(LPC):
        k = r[i + 1].copy()
        for j in range(i):
            k -= a[j] * r[i - j]
        k /= err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = err * (1 - k * k)
    shift = np.clip(PRECISION - 1 - np.frexp(np.abs(a).max(axis=0))[1], 0, 15).astype(np.int32)
    most = 1 << (PRECISION - 1)
    weights = np.clip(np.rint(np.ldexp(a, shift)), -most, most - 1).astype(np.int32)
    seen = np.zeros(len(x), np.int32)
    for j in range(LPC):
        seen[j + 1 :] += np.repeat(weights[j], size)[j + 1 :] * x[: -j - 1]
    seen >>= np.repeat(shift, size)
    return weights, shift, x - seen


def _frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All frames one after another: bytes, and each frame's place and length. The frames' samples follow one another in buf."""
    n_frames = len(start)
    if not n_frames:
        return np.zeros(0, np.uint8), start, size
    x = buf.view(np.int8).astype(np.int32)
    first = np.cumsum(size) - size
    frame = np.repeat(np.arange(n_frames, dtype=np.int32), size)
    inside = np.arange(len(x), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    d1 = np.diff(x, prepend=np.int32(0))
    d2 = np.diff(d1, prepend=np.int32(0))
    resid = [x, d1, d2]
    cost = []
    for o, d in enumerate(resid):
        s = np.abs(d)
        for j in range(o):
            s[first[size > j] + j] = 0
        s = np.add.reduceat(s, first, dtype=np.int64)
        cost.append(np.where(size > o, s, 1 << 40))
    order = np.argmin(cost, axis=0)
    weights, shift, d = _predict(x, first, size)
    s = np.abs(d)
    for j in range(LPC):
        s[first[size > j] + j] = 0
    s = np.add.reduceat(s, first, dtype=np.int64)
    # Halving the mean residual saves a bit a sample: the coefficients' and warm-up samples' bits have to be saved.
    lpc = (size > 4 * LPC) & (np.min(cost, axis=0) * size > s * (size + 60))
    resid.append(d)
    pick = np.where(lpc, 3, order)
    mine = np.repeat(pick.astype(np.int32), size)
    r = d1.copy()
    for o in (0, 2, 3):
        if (pick == o).any():
            np.copyto(r, resid[o], where=mine == o)
    order = np.where(lpc, LPC, order)
    mine = np.repeat(order.astype(np.int32), size)
    coded = inside >= mine
    u = (r << 1) ^ (r >> 31)
    u[~coded] = 0
    m = size - order
    mean = np.add.reduceat(u, first, dtype=np.int64) / np.maximum(m, 1)
    guess = np.clip(np.frexp(np.maximum(mean * 0.7, 1))[1].astype(np.int64) - 1, 0, 12)
    best, bits = guess, None
    for k in (guess, np.maximum(guess - 1, 0), guess + 1):
        b = np.add.reduceat(u >> np.repeat(k.astype(np.int32), size), first, dtype=np.int64) + m * (k + 1)
        best, bits = (k, b) if bits is None else (np.where(b < bits, k, best), np.minimum(b, bits))
    constant = np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first)
    ahead = np.where(lpc, LPC_BITS, 0)
    rice_bytes = 1 + order + (ahead + 10 + bits + 7) // 8
    verbatim = ~constant & (rice_bytes >= 1 + size)
    rice = ~constant & ~verbatim
    heads = [_frame_header(a, b) for a, b in zip(number.tolist(), size.tolist(), strict=True)]
    head_len = np.array([len(h) for h in heads])
    length = head_len + np.where(constant, 2, np.where(verbatim, 1 + size, rice_bytes)) + 2
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) + 8, np.uint8)
    h_first = np.cumsum(head_len) - head_len
    out[np.repeat(at - h_first, head_len) + np.arange(int(head_len.sum()))] = np.frombuffer(b"".join(heads), np.uint8)
    sub = at + head_len
    out[sub] = np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, 64 + 2 * (order - 1), 16 + 2 * order)))
    out[sub[constant] + 1] = buf[first[constant]]
    raw = (verbatim[frame]) | (rice[frame] & ~coded)
    where = np.flatnonzero(raw)
    out[sub[frame[where]] + 1 + inside[where]] = buf[where]
    # Rice codes: zeros, a one, the low bits. The one and the low bits lie within three bytes; their bits never meet in a byte, so sums join them.
    i = np.flatnonzero(rice[frame] & coded)
    if len(i):
        v = u[i]
        count = np.where(rice, m, 0)
        k = np.repeat(best.astype(np.int32), count)
        q = v >> k
        q += k
        ends = np.cumsum(q + 1)
        lead = np.cumsum(count) - count
        base = 8 * (sub + 1 + order) + ahead + 10
        base[rice] -= np.where(lead > 0, ends[lead - 1], 0)[rice]
        one = np.repeat(base, count) + ends - k - 1
        word = ((v & ((1 << k) - 1)) | (1 << k)) << (23 - (one & 7).astype(np.int32) - k)
        byte = one >> 3
        put = np.bincount(byte, word >> 16, len(out)) + np.bincount(byte + 1, word >> 8 & 255, len(out)) + np.bincount(byte + 2, word & 255, len(out))
        out += put.astype(np.uint8)
        f = np.flatnonzero(rice & ~lpc)
        where = (sub + 1 + order)[f]
        out[where] += (best[f] >> 2).astype(np.uint8)
        out[where + 1] += (best[f] << 6 & 255).astype(np.uint8)
        f = np.flatnonzero(rice & lpc)
        where = (sub + 1 + order)[f]
        bits_ = np.full(len(f), PRECISION - 1, np.uint64) << np.uint64(5) | shift[f].astype(np.uint64)
        for w in weights[:, f]:
            bits_ = bits_ << np.uint64(PRECISION) | (w & ((1 << PRECISION) - 1)).astype(np.uint64)
        # LPC_BITS bits and the 10 of the residuals' head, from the left of nine bytes.
        out[where] = (bits_ >> np.uint64(LPC_BITS - 8)).astype(np.uint8)
        low = bits_ << np.uint64(72 - LPC_BITS) | best[f].astype(np.uint64) << np.uint64(72 - LPC_BITS - 10)
        for j in range(8):
            out[where + 1 + j] += (low >> np.uint64(56 - 8 * j)).astype(np.uint8)
    crc = crc16(out, at, at + length - 2)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 0xFF
    return out, at, length


# ---------------------------------------------------------------- decoding, any frame


class FlacError(ValueError):
    pass


class Bits:
    """Reads big-endian bits of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.pos, self.end = data, 8 * at, 8 * len(data)

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, z = self.pos >> 3, (self.pos + n + 7) >> 3
        if self.pos + n > self.end:
            raise FlacError("the stream ends within a frame")
        v = int.from_bytes(self.data[a:z], "big") >> (8 * z - self.pos - n)
        self.pos += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        """Zeros up to the next one, which is read too."""
        n = 0
        while True:
            room = min(32, self.end - self.pos)
            if room <= 0:
                raise FlacError("the stream ends within a frame")
            v = self.take(room)
            if v:
                lead = room - v.bit_length()
                self.pos -= room - lead - 1
                return n + lead
            n += room


def stream_info(data: bytes) -> tuple[dict, int]:
    """What STREAMINFO says, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("the stream ends within its metadata")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            b = data[at + 4 : at + 4 + size]
            v = int.from_bytes(b[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & ((1 << 36) - 1), "block": int.from_bytes(b[2:4], "big"), "md5": b[18:34]}
        at += 4 + size
        if kind & 0x80:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    return info, at


def frame_header(data: bytes, at: int, info: dict) -> dict:
    """A frame's header, with its CRC-8 verified."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    variable, b2, b3 = data[at + 1] & 1, data[at + 2], data[at + 3]
    lead, p = data[at + 4], at + 5
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length()
    more = 0 if lead < 0x80 else 8 - more - 1
    number = lead if lead < 0x80 else lead & ((1 << max(0, 6 - more)) - 1)
    for _ in range(more):
        if p >= len(data):
            raise FlacError("the stream ends within a frame")
        number = number << 6 | data[p] & 0x3F
        p += 1
    code = b2 >> 4
    if code == 6:
        size, p = int.from_bytes(data[p : p + 1], "big") + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
    rate = b2 & 15
    p += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if not size or rate == 15 or p >= len(data) or crc8(data[at:p]) != data[p]:
        raise FlacError("bad frame header")
    bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(b3 >> 1 & 7)
    if bits is None or b3 >> 4 > 10:
        raise FlacError("bad frame header")
    return {"size": size, "number": number, "variable": variable, "mode": b3 >> 4, "bits": bits, "body": p + 1}


def _residuals(bits: Bits, size: int, order: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, parts = (4, 5)[method], 1 << bits.take(4)
    out: list[int] = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            v = bits.zeros() << k | bits.take(k)
            out.append(v >> 1 ^ -(v & 1))
    return out


#: Weights of the samples before, of the fixed predictors of order 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise FlacError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
        depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift, weights = [bits.signed(depth) for _ in range(order)], 0, FIXED[order] if kind < 32 else []
        if kind >= 32:
            width = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(width) for _ in range(order)]
        for r in _residuals(bits, size, order):
            seen = sum(w * out[-1 - j] for j, w in enumerate(weights))
            out.append(r + (seen >> shift if shift >= 0 else seen << -shift))
    else:
        raise FlacError("reserved subframe type")
    return np.array(out, np.int64) << wasted


def decode_frame(data: bytes, at: int, info: dict) -> tuple[np.ndarray, dict, int]:
    """Samples (channels x size), the header, and where the next frame begins."""
    head = frame_header(data, at, info)
    bits, mode = Bits(data, head["body"]), head["mode"]
    n = mode + 1 if mode < 8 else 2
    chans = [_subframe(bits, head["size"], head["bits"] + (1 if (mode, c) in ((8, 1), (9, 0), (10, 1)) else 0)) for c in range(n)]
    if mode == 8:
        chans[1] = chans[0] - chans[1]
    elif mode == 9:
        chans[0] = chans[0] + chans[1]
    elif mode == 10:
        mid = chans[0] << 1 | chans[1] & 1
        chans = [(mid + chans[1]) >> 1, (mid - chans[1]) >> 1]
    end = (bits.pos + 7) >> 3
    if end + 2 > len(data):
        raise FlacError("the stream ends within a frame")
    raw = np.frombuffer(data, np.uint8)
    if int(crc16(raw, np.array([at]), np.array([end]))[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError(f"frame {head['number']}: wrong CRC-16")
    return np.stack(chans), head, end + 2


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes."""
    w = (bits + 7) // 8
    if w == 1 and len(samples) == 1:
        return samples[0].astype(np.int8).tobytes()
    flat = np.ascontiguousarray(samples.T).reshape(-1).astype("<i4")
    return flat.view(np.uint8).reshape(-1, 4)[:, :w].tobytes()


def decode_stream(data: bytes) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """Info, and (first sample, samples) of each frame; frame after frame by the bit reader."""
    info, at = stream_info(data)
    done, blocks = 0, []
    while at < len(data) and (done < info["samples"] or not info["samples"]):
        samples, head, at = decode_frame(data, at, info)
        blocks.append((head["number"] if head["variable"] else done, samples))
        done += samples.shape[1]
    if info["samples"] and done != info["samples"]:
        raise FlacError(f"{done} samples; STREAMINFO says {info['samples']}")
    return info, blocks


# ---------------------------------------------------------------- decoding, many plain frames at once


def _find_frames(data: bytes, at: int, marks: np.ndarray, info: dict) -> list[tuple[int, dict]] | None:
    """Frames of a plain stream: place and header; None if the stream isn't plain."""
    found, done = [], 0
    for p in marks.tolist():
        if p < at or done >= info["samples"]:
            continue
        try:
            h = frame_header(data, p, info)
        except FlacError:
            continue
        if h["number"] != len(found) or h["variable"] or not found and p != at:
            continue
        if h["mode"] or h["bits"] != 8:
            return None
        found.append((p, h))
        done += h["size"]
    return found if done == info["samples"] else None


def decode_batch(streams: list[bytes]) -> list[tuple[dict, np.ndarray, list[int]] | FlacError]:
    """For each stream its info, samples (channels x samples) and the first sample of each block, or what is wrong with it."""
    out: list = [None] * len(streams)
    buf = np.frombuffer(b"".join([*streams, bytes(8)]), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    marks = np.flatnonzero((buf[:-1] == 0xFF) & (buf[1:] == 0xF8))
    cut = np.searchsorted(marks, base)
    plan, infos = [], {}
    for i, data in enumerate(streams):
        try:
            info, at = stream_info(data)
            frames = _find_frames(data, at, marks[cut[i] : cut[i + 1]] - base[i], info) if info["channels"] == 1 and info["bits"] == 8 and info["samples"] else None
        except FlacError as e:
            out[i] = e
            continue
        if frames is not None:
            infos[i] = info
            ends = [*(p for p, _ in frames[1:]), len(data)]
            plan += [(i, base[i] + p, base[i] + h["body"], h["size"], base[i] + z) for (p, h), z in zip(frames, ends, strict=True)]
    samples, good = _plain_pieces(buf, plan)
    at = 0
    k = 0
    for i in range(len(streams)):
        if i in infos:
            first, n, ok, offsets = at, 0, True, []
            while k < len(plan) and plan[k][0] == i:
                ok &= bool(good[k])
                offsets.append(n)
                n += plan[k][3]
                k += 1
            at = first + n
            if ok:
                out[i] = (infos[i], samples[first:at][None], offsets)
        if out[i] is None:
            try:
                info, blocks = decode_stream(streams[i])
                out[i] = (info, np.concatenate([b for _, b in blocks], axis=1) if blocks else np.zeros((info["channels"], 0), np.int64), [o for o, _ in blocks])
            except FlacError as e:
                out[i] = e
        if not isinstance(out[i], FlacError):
            info, s, _ = out[i]
            if info["md5"] != bytes(16) and hashlib.md5(pcm_bytes(s, info["bits"])).digest() != info["md5"]:
                out[i] = FlacError("the samples' MD5 differs from STREAMINFO's")
    return out


def _plain_pieces(buf: np.ndarray, plan: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """_plain_frames for about PIECE samples at a time; whole frames' samples have 8 bits."""
    size = np.array([p[3] for p in plan], np.int64)
    out, good = np.zeros(int(size.sum()), np.int8), np.zeros(len(plan), bool)
    first = np.cumsum(size) - size
    for a, z in _runs(size):
        lo, hi = int(plan[a][1]), int(plan[z - 1][4])
        x, good[a:z] = _plain_frames(np.concatenate([buf[lo:hi], np.zeros(8, np.uint8)]), [(i, p - lo, q - lo, n, e - lo) for i, p, q, n, e in plan[a:z]])
        out[first[a] : first[a] + len(x)] = x
    return out, good


def _plain_frames(buf: np.ndarray, plan: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all frames in a row, and which frames are whole."""
    _, at, sub, size, end = (np.array(c, np.int64) for c in zip(*plan, strict=True))
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int32)
    crc_ok = crc16(buf, at, end - 2) == (buf[end - 2].astype(np.uint16) << 8 | buf[end - 1])
    kind = buf[sub]
    good = np.zeros(len(at), bool)
    signed = buf.view(np.int8)
    c = np.flatnonzero(kind == 0)
    for f in c.tolist():
        out[first[f] : first[f] + size[f]] = signed[sub[f] + 1]
    good[c] = end[c] == sub[c] + 4
    for f in np.flatnonzero((kind == 2) & (end == sub + 3 + size)).tolist():
        out[first[f] : first[f] + size[f]] = signed[sub[f] + 1 : sub[f] + 1 + size[f]]
        good[f] = True
    linear = (kind >= 64) & (kind < 128) & (kind % 2 == 0)
    order = np.where(linear, (kind.astype(np.int64) >> 1) - 31, (kind.astype(np.int64) - 16) >> 1)
    plain = ((kind >= 16) & (kind <= 24) & (kind % 2 == 0) | linear) & (size > order) & (sub + 1 + order + 2 <= end - 2)
    body = 8 * (sub + 1 + np.where(plain, order, 0))  # the bit behind the warm-up samples
    rules = {}
    for f in np.flatnonzero(linear & plain).tolist():
        try:
            bits = Bits(buf[body[f] >> 3 : end[f] - 2].tobytes()[:80])
            width = bits.take(4) + 1
            shift = bits.signed(5)
            rules[f] = shift, [bits.signed(width) for _ in range(order[f])]
            body[f] += bits.pos
        except FlacError:
            plain[f] = False
        else:
            plain[f] = shift >= 0
    at8 = np.minimum(body >> 3, len(buf) - 3)
    param = (buf[at8].astype(np.int64) << 16 | buf[at8 + 1].astype(np.int64) << 8 | buf[at8 + 2]) >> (14 - (body & 7)) & 1023  # 2 bits of method, 4 of partitions, 4 of parameter
    plain &= (param >> 4 == 0) & (param & 15 != 15)
    r = np.flatnonzero(plain)
    if len(r):
        r = r[np.argsort(-(size[r] - order[r]), kind="stable")]
        values, ended = _rice(buf, body[r] + 10, param[r] & 15, size[r] - order[r])
        good[r] = (ended + 7) // 8 + 2 == end[r]
        v_at = np.cumsum(size[r] - order[r]) - (size[r] - order[r])
        for o in np.unique(order[r][linear[r]]).tolist():
            mine = np.flatnonzero((order[r] == o) & linear[r] & good[r])
            if len(mine):
                f = r[mine]
                warm = np.stack([signed[sub[f] + 1 + j].astype(np.int64) for j in range(o)])
                for g, s in zip(f.tolist(), _unpredict(values, v_at[mine], size[f] - o, warm, [rules[g] for g in f.tolist()]), strict=True):
                    out[first[g] : first[g] + size[g]] = s
        for o in np.unique(order[r]).tolist():
            mine = np.flatnonzero((order[r] == o) & ~linear[r] & good[r])
            if not len(mine):
                continue
            f, m = r[mine], size[r[mine]] - o
            lead = np.cumsum(m) - m
            v = values[np.repeat(v_at[mine] - lead, m) + np.arange(int(m.sum()))]
            warm = [signed[sub[f] + 1 + j].astype(np.int64) for j in range(o)]
            for j in range(o - 1, -1, -1):  # undo one difference after another
                d = warm[: j + 1]
                while len(d) > 1:
                    d = [b - a for a, b in zip(d, d[1:], strict=False)]
                v = np.insert(v, lead, d[0])
                m = m + 1
                lead = np.cumsum(m) - m
                total = np.cumsum(v)
                v = total - np.repeat(total[lead] - v[lead], m)
            out[np.repeat(first[f] - lead, m) + np.arange(len(v))] = v
    return out, good & crc_ok


def _unpredict(values: np.ndarray, at: np.ndarray, count: np.ndarray, warm: np.ndarray, rules: list[tuple[int, list[int]]]) -> list[np.ndarray]:
    """Samples of frames (longest first) with linear predictors of one order. One step makes one sample of every frame."""
    o, most = len(warm), int(count[0])
    kind = np.int64 if max(sum(map(abs, w)) for _, w in rules) > 1 << 22 else np.int32
    shift = np.array([s for s, _ in rules], kind)
    weights = np.array([w[::-1] for _, w in rules], kind).T.copy()
    made = np.zeros((o + most, len(count)), kind)
    made[:o] = warm
    inside = np.arange(most)[:, None] < count
    lead = np.zeros((len(count), most), kind)
    lead[inside.T] = values[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    made[o:] = lead.T
    active = np.searchsorted(-count, -np.arange(1, most + 1), "right")
    for t, a in enumerate(active.tolist()):
        seen = np.einsum("jf,jf->f", weights[:, :a], made[t : t + o, :a])
        seen >>= shift[:a]
        made[t + o, :a] += seen
    return [made[: o + n, i] for i, n in enumerate(count.tolist())]


def _rice(buf: np.ndarray, start: np.ndarray, k: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames (longest first) in a row, and the bit where each ends. One step reads one residual of every frame."""
    bits = np.unpackbits(buf)
    n = len(bits)
    ones = np.where(bits, np.arange(n, dtype=np.int32), np.int32(n - 1))
    ones = np.ascontiguousarray(np.minimum.accumulate(ones[::-1])[::-1])
    most = int(count[0])
    active = np.searchsorted(-count, -np.arange(1, most + 1), "right")
    term = np.zeros((most, len(count)), np.int32)
    p, skip = start.astype(np.int32), (k + 1).astype(np.int32)
    last = np.int32(n - 1)
    for t, a in enumerate(active.tolist()):
        row = term[t, :a]
        np.take(ones, p[:a], out=row, mode="clip")
        np.add(row, skip[:a], out=p[:a])
        if not t & 255:
            np.minimum(p, last, out=p)
    used = np.arange(most)[None, :] < count[:, None]
    terms = np.ascontiguousarray(term.T)[used]
    k = k.astype(np.int32)
    kk = np.repeat(k, count)
    begin = np.empty(len(terms), np.int32)
    begin[1:] = terms[:-1] + 1 + kk[1:]
    lead = np.cumsum(count) - count
    begin[lead] = start
    pos = np.minimum(terms + 1, n - 32)
    wide = buf.astype(np.int32)
    three = np.zeros(len(buf), np.int32)
    three[:-2] = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    word = three[pos >> 3]
    low = (word >> (24 - (pos & 7) - kk)) & ((1 << kk) - 1)
    u = (terms - begin) << kk | low
    return (u >> 1) ^ -(u & 1), terms[lead + count - 1] + 1 + k


# ---------------------------------------------------------------- DataFrame operators


def encode_media(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, media: a FLAC stream of the column's bytes (text as UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(1), PIECE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(encode(buf, off), pa.binary())], [key, "media"])

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, media binary")


def pcm_blocks(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, block, sample_offset, n_samples, rate, channels, bits, pcm, error: one row for each decoded block, from which a reader can seek to any sample; one row with an error for a damaged stream."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            for i, j, _, _ in pieces(b.column(1), PIECE):
                part = b.slice(i, j - i)
                have = [n for n, v in enumerate(part.column(1)) if v.is_valid]
                which, cols = [], [[] for _ in range(8)]
                for n, got in zip(have, decode_batch([part.column(1)[n].as_py() for n in have]), strict=True):
                    if isinstance(got, FlacError):
                        which.append(i + n)
                        for c, v in zip(cols, (None, None, None, None, None, None, None, str(got)), strict=True):
                            c.append(v)
                        continue
                    info, samples, offsets = got
                    for k, (a, z) in enumerate(zip(offsets, [*offsets[1:], samples.shape[1]][: len(offsets)], strict=True)):
                        which.append(i + n)
                        for c, v in zip(cols, (k, a, z - a, info["rate"], info["channels"], info["bits"], pcm_bytes(samples[:, a:z], info["bits"]), None), strict=True):
                            c.append(v)
                if which:
                    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(which)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, "block", "sample_offset", "n_samples", "rate", "channels", "bits", "pcm", "error"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, block long, sample_offset long, n_samples long, rate int, channels int, bits int, pcm binary, error string")


def padded(buf: np.ndarray, off: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Each text with spaces appended up to a positive multiple of unit."""
    n = np.diff(off)
    to = np.maximum(1, -(-n // unit)) * unit
    new = np.concatenate([[0], np.cumsum(to)])
    out = np.full(int(new[-1]), 32, np.uint8)
    out[np.repeat(new[:-1] - off[:-1], n) + np.arange(len(buf))] = buf
    return out, new


class _Digest:
    """What describes a payload, block after block."""

    def __init__(self):
        self.sha, self.tail, self.n, self.blocks, self.sum, self.energy, self.crossings = hashlib.sha256(), b"", 0, 0, 0, 0, 0
        self.least, self.most, self.last = 127, -128, None

    def add(self, pcm: bytes, rate: int) -> None:
        s = np.frombuffer(pcm, np.int8).astype(np.int64)
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]
        sign = np.signbit(s) if self.last is None else np.concatenate([[self.last], np.signbit(s)])
        self.crossings += int(np.count_nonzero(np.diff(sign)))
        self.last, self.rate = sign[-1], rate
        self.n, self.blocks, self.sum, self.energy = self.n + len(s), self.blocks + 1, self.sum + int(s.sum()), self.energy + int((s * s).sum())
        self.least, self.most = min(self.least, int(s.min())), max(self.most, int(s.max()))

    def row(self, stream: dict) -> tuple:
        feature = f"rate={self.rate};samples={self.n};blocks={self.blocks};sum={self.sum};energy={self.energy};min={self.least};max={self.most};crossings={self.crossings}"
        return stream["doc_id"], stream["n_bytes"], self.n, self.sha.hexdigest(), zlib.crc32(self.tail), stream["media_bytes"], stream["media_sha256"], feature


def store_media(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes (of the text), media: the padded texts' FLAC streams, written to the shared folder and read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(2), PIECE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(off), pa.int64()), pa.array(encode(*padded(buf, off)), pa.binary())], ["row", "doc_id", "n_bytes", "media"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(rows.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary"), "media")


def media_rows(docs: DataFrame) -> DataFrame:
    """Stores each padded text as a FLAC stream, reads the stored streams' PCM blocks and describes what comes back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, digest = None, None  # blocks of a stream follow each other, also into the next batch
        for b in batches:
            done = []
            for x, rate, pcm, error in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("stream", "rate", "pcm", "error")), strict=True):
                if error is not None:
                    raise FlacError(error)
                if stream is None or x["row"] != stream["row"]:
                    if stream is not None:
                        done.append(digest.row(stream))
                    stream, digest = x, _Digest()
                digest.add(pcm, rate)
            if done:
                yield out(b, done)
        if stream is not None:
            yield out(b, [digest.row(stream)])

    def out(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        types = [b.schema.field("stream").type.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    stream = F.struct("row", "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    blocks = pcm_blocks(store_media(docs).select(stream.alias("stream"), "media"), "stream")
    return blocks.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_rows(table(spark, sf_dir, "documents"))
