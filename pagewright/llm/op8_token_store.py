"""Token-ID output: raw id payloads in document order, and a minimal perfect hash index over them.

Store layout, below one folder:
  payload/shard-NNNNN.bin   ids only, little-endian, 2 bytes each where the vocabulary has at most 65,536 entries, else 4
  index/bucket-NNNNN.mph    minimal perfect hash of the keys that fall in the bucket, then one record for each slot:
                            fingerprint, shard, first id, number of ids

A key is a document's id and its copy number (0 for the first row with that id). Two hash evaluations, one rank and one record
lead from a key to its payload range, whatever the number of documents; the stored fingerprint tells foreign keys apart
(a foreign key passes with probability 2^-32).

The perfect hash has levels of bitmaps: a key alone at its position of a level is settled there, the others go to the next
level; a slot is the number of set bits before a key's bit.

Scale: texts are shuffled once, by ranges of doc_id; everything after moves rows of about 40 bytes. A task streams its range to
its shard; memory holds one Arrow batch, about CHUNK signs of text at a time (longer texts are cut where ids are cut) and a cache of
CACHE_WORDS word encodings. Each file is written under a name of its own and renamed, so repeated tasks are harmless. Copies of an id are
numbered along the shards; no window gathers the rows of an id.

Null texts count as empty and give the end id alone. A null doc_id is a key like any other: it sorts first. Repeated rows
are all written, in an order fixed by text, and get copy numbers. Other columns are ignored. An empty table gives a store without documents.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import files
from pagewright.llm.ranks import carried
from pagewright.llm.textbatch import TRIM_BYTES, claim, scramble, trim
from pagewright.session import materialize, scratch_path, table

END_ID = 2
BUCKET_KEYS = 50_000
CACHE_WORDS = 800_000
CHUNK = 1 << 22

# ---------------------------------------------------------------- encoding

#: White space other than space and line feed.
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(t: str) -> bool:
    """Every white space is one space or one line feed between two other characters."""
    return not ("  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n" or _ODD.search(t))


_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")


#: What may follow a word; between a letter and one of these every text is cut.
_TAIL = ".,;:!?*#$%&|)]}\"-"


#: Letters below this sign are letters in every version of Unicode that the library may use.
_OLD = "\u0530"
#: The byte-level alphabet: printable Latin-1 signs stand for themselves, the other bytes for signs from U+0100 on, in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_ALPHABET = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _ends_in_letter(col: pa.Array, texts: list[str]) -> np.ndarray:
    """For each text (the same in both forms) whether its last sign is a letter of an old block."""
    end, data = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1], np.frombuffer(col.buffers()[2] or b"\0", np.uint8)
    last = np.where(end[1:] > end[:-1], data[np.maximum(end[1:], 1) - 1], 0)
    out = (last | 32 >= 97) & (last | 32 <= 122)
    for i in np.flatnonzero(last >= 128).tolist():
        out[i] = texts[i][-1].isalpha() and texts[i][-1] < _OLD
    return out


class WordCoder:
    """Encodes whole texts with a byte-level BPE tokenizer whose pre-tokenizer never joins a word with what follows it.

    Such a tokenizer cuts a text before each space that stands between two other characters, around a line end that does, and
    between a letter and punctuation; so the ids of a text are those of its pieces, and each different piece is encoded once while the cache lasts.
    A batch's pieces are numbered by Arrow's dictionary encoding; ids are then gathered for all pieces at once, without a loop over them. A piece of
    letters only is a single pre-token and goes straight to the tokenizer's model.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.line = self._raw("\n")
        self.straight = all(self._raw(f" {w}") == self._letters(f" {w}") for w in ("the", "Été", "слово", "internationalization"))
        #: Ids of pieces that begin a line or text, and of words behind a space (without it).
        self.first: dict[str, bytes] = {"": b""}
        self.next: dict[str, bytes] = {}
        self._old_first, self._old_next = dict(self.first), {}

    def _raw(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, piece: str) -> bytes:
        return np.array([t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))], self.dtype).tobytes()

    def _bulk(self, texts: list[str]) -> list[bytes]:
        """Encodes pieces: those of letters by the model, the others in few calls, a line end between them: its id marks where each piece's ids end."""
        out: list = [None] * len(texts)
        plain, w, model, code = [], self.dtype.itemsize, self.tok.model, "H" if self.dtype.itemsize == 2 else "I"
        for i, p in enumerate(texts):
            q = p[1:] if p[0] == " " else p
            if self.straight and q.isalpha() and (q.isascii() or max(q) < _OLD):
                shown = p.encode().decode("latin-1").translate(_ALPHABET) if not q.isascii() else f"\u0120{q}" if q is not p else q
                out[i] = array(code, [t.id for t in model.tokenize(shown)]).tobytes()
            elif q and "\n" not in q and not q[0].isspace() and not q[-1].isspace():
                plain.append(i)
            else:
                out[i] = self._raw(p)
        sep = int(np.frombuffer(self.line, self.dtype)[0])
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast(["\n".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(ids == sep)
            if len(self.line) != w or len(cut) != len(part) - 1:
                for i in part:
                    out[i] = self._raw(texts[i])
                continue
            raw = ids.tobytes()
            for i, a, z in zip(part, [0, *((cut + 1) * w).tolist()], [*(cut * w).tolist(), len(raw)], strict=True):
                out[i] = raw[a:z]
        return out

    def _get(self, pieces_: list[str], behind_space: bool) -> list[bytes]:
        """Ids of different pieces. The cache has two generations: when the younger one is full it becomes the older one, and what is asked for moves back."""
        now, old = (self.next, self._old_next) if behind_space else (self.first, self._old_first)
        out = [now.get(p) for p in pieces_]
        lost = [i for i, v in enumerate(out) if v is None]
        if not lost:
            return out
        if len(self.first) + len(self.next) + len(lost) > CACHE_WORDS // 2:
            self._old_first, self._old_next, self.first, self.next = self.first, self.next, {"": b""}, {}
            now = self.next if behind_space else self.first
        new = []
        for i in lost:
            p = pieces_[i]
            v = out[i] = old.get(p)
            if v is None:
                new.append(i)
            else:
                now[p] = v
        lead = " " if behind_space else ""
        for i, v in zip(new, self._bulk([lead + pieces_[i] for i in new]), strict=True):
            out[i] = now[pieces_[i]] = v
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        odd = [i for i, t in enumerate(texts) if t and not _plain(t)]
        skip = set(odd)
        order = [i for i in range(len(texts)) if i not in skip] if odd else list(range(len(texts)))
        lines = pc.split_pattern(pa.array([texts[i] for i in order], pa.large_string()), "\n")
        words = pc.split_pattern(lines.values, " ")
        flat, line_at, text_at = words.values, words.offsets.to_numpy().astype(np.int64), lines.offsets.to_numpy().astype(np.int64)
        if odd:  # what isn't plain is one line, cut where a single space stands between two characters
            cut = [_CUT.split(texts[i]) for i in odd]
            flat = pa.concat_arrays([flat, pa.array([p for c in cut for p in c], pa.large_string())])
            line_at = np.concatenate([line_at, line_at[-1] + np.cumsum([len(c) for c in cut])])
            text_at = np.concatenate([text_at, text_at[-1] + 1 + np.arange(len(odd))])
            order += odd
        # Punctuation behind a letter is a piece of its own. Tails of one sign are known by it, longer ones by their number among the batch's tails.
        coded = pc.ascii_rtrim(flat, characters=_TAIL).dictionary_encode()
        cores, core = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        core_size = pc.binary_length(coded.dictionary).to_numpy()
        tail = pc.binary_length(flat).to_numpy() - core_size[core]
        letter = _ends_in_letter(coded.dictionary, cores)
        whole = np.flatnonzero((tail > 0) & ~letter[core])
        tail[whole] = 0
        late = pc.take(flat, pa.array(whole)).dictionary_encode()
        core[whole] = len(cores) + late.indices.to_numpy()
        cores += late.dictionary.to_pylist()
        end, data = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset + 1 : flat.offset + 1 + len(flat)], np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        tailed = np.flatnonzero(tail > 0)
        sign = np.zeros(len(tailed), np.int64)
        one = tail[tailed] == 1
        sign[one] = data[end[tailed[one]] - 1]
        more = [data[e - n : e].tobytes().decode() for e, n in zip(end[tailed[~one]].tolist(), tail[tailed[~one]].tolist(), strict=True)]
        number = {t: 128 + i for i, t in enumerate(dict.fromkeys(more))}
        sign[~one] = [number[t] for t in more]
        # A piece is behind a space (0), at the beginning of a text (1) or of a later line, behind that line end (2). Tails are numbered behind all of these.
        place = np.zeros(len(core), np.int64)
        place[line_at[:-1]] = 2
        place[line_at[text_at[:-1]]] = 1
        at = np.arange(len(core) + 1)
        at[1:] += np.cumsum(tail > 0)
        unit = np.empty(at[-1], np.int64)
        unit[at[:-1]] = core * 3 + place
        unit[at[tailed] + 1] = 3 * len(cores) + sign
        seen = np.zeros(3 * len(cores) + 128 + len(number), bool)
        seen[unit] = True
        seen = np.flatnonzero(seen)
        mains = np.searchsorted(seen, 3 * len(cores))
        behind = seen[:mains] % 3
        names = [cores[i] for i in (seen[:mains] // 3).tolist()]
        inner = np.flatnonzero(behind == 0)
        raw: list = [None] * len(seen)
        for i, v in zip(inner.tolist(), self._get([names[i] for i in inner.tolist()], True), strict=True):
            raw[i] = v
        outer = np.flatnonzero(behind).tolist()
        for i, v in zip(outer, self._get([names[i] for i in outer], False), strict=True):
            raw[i] = v if behind[i] == 1 else self.line + v
        tails = [*map(chr, range(128)), *number]
        raw[mains:] = self._get([tails[i] for i in (seen[mains:] - 3 * len(cores)).tolist()], False)
        size = np.zeros(3 * len(cores) + 128 + len(number), np.int64)
        size[seen] = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(raw), self.dtype)
        n = size[unit]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(begin[unit] - ends[:-1], n) + np.arange(int(ends[-1]))]
        total = np.diff(ends[at[line_at[text_at]]])
        if not odd:
            return out, total
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin, n = (np.cumsum(total) - total)[back], total[back]
        ends = np.cumsum(n)
        return out[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))], n

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, n = self.encode_all(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


# ---------------------------------------------------------------- minimal perfect hash

_SEED = scramble(np.arange(1, 130, dtype=np.uint64))
GAMMA, LEVELS = 2.0, 48


def key_hash(doc_id: np.ndarray, copy: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Of keys' ids (anything where null), copy numbers and whether the id is null."""
    known = np.where(null, np.uint64(0xC2B2AE3D27D4EB4F), doc_id.astype(np.int64).view(np.uint64))
    return scramble(known + scramble(copy.astype(np.uint64) + (null.astype(np.uint64) << np.uint64(63))) * ((copy != 0) | null))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (scramble(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """slots(h) is a bijection from the keys' hashes to 0..n-1. rest: hashes that no level could settle (equal ones), in order."""

    sizes: np.ndarray
    bits: np.ndarray
    rest: np.ndarray

    def __post_init__(self):
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, maps, left = [], [], h
        while len(left) and len(sizes) < LEVELS:
            m = max(8, int(GAMMA * len(left)))
            pos = (scramble(left ^ _SEED[len(sizes)]) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(pos, minlength=m) == 1
            sizes.append(m)
            maps.append(alone)
            left = left[~alone[pos]]
        return cls(np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, bool), left)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """-1 where a hash isn't of the set, as far as the levels tell."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for k, m in enumerate(self.sizes.tolist()):
            pos = (scramble(h[todo] ^ _SEED[k]) % np.uint64(m)).astype(np.int64) + self.base[k]
            hit = self.bits[pos]
            out[todo[hit]] = self.rank[pos[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        if len(todo) and len(self.rest):
            order = np.argsort(self.rest, kind="stable")
            at = np.minimum(np.searchsorted(self.rest[order], h[todo]), len(order) - 1)
            hit = self.rest[order[at]] == h[todo]
            out[todo[hit]] = self.rank[-1] + order[at[hit]]
        return out

    def pack(self) -> bytes:
        raw = np.packbits(self.bits).tobytes()
        return struct.pack("<III", len(self.sizes), len(raw), len(self.rest)) + self.sizes.astype("<i8").tobytes() + raw + self.rest.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[PerfectHash, int]:
        a, b, c = struct.unpack_from("<III", raw)
        at = 12 + 8 * a
        sizes = np.frombuffer(raw, "<i8", a, 12)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, b, at), count=int(sizes.sum())).astype(bool)
        return cls(sizes, bits, np.frombuffer(raw, "<u8", c, at + b)), at + b + 8 * c


RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8"), ("doc_id", "<i8"), ("null", "u1"), ("copy", "<u4")])


# ---------------------------------------------------------------- store


@dataclass
class Store:
    path: str
    width: int
    buckets: int
    #: One row for each document: doc_id, copy, shard, first, n_tokens.
    entries: DataFrame

    def shard(self, n: int) -> str:
        return f"{self.path}/payload/shard-{n:05d}.bin"

    def bucket(self, n: int) -> str:
        return f"{self.path}/index/bucket-{n:05d}.mph"


_CODERS: dict = {}


def _coder(path: str, special_as_text: bool) -> WordCoder:
    """One for each worker process, with its cache, until another operator or a later step of this one works there."""
    claim("tokens", _CODERS.clear)
    if (path, special_as_text) not in _CODERS:
        _CODERS[path, special_as_text] = WordCoder(path, special_as_text)
    return _CODERS[path, special_as_text]


def _coded() -> None:
    """Said where a store's texts are all encoded: the coders' caches are of no more use to this worker."""
    claim("store")


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[bool]]]:
    """Texts in runs of about CHUNK signs: parts, the text of each, and whether it is that text's last. A longer text is cut before a space between two other signs, where its ids are cut, too."""
    parts, owner, last, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at is not None:
            m = _CUT.search(t, at + CHUNK) if len(t) - at > 2 * CHUNK else None
            parts.append(t[at : m.start()] if m else t[at:] if at else t)
            owner.append(i)
            last.append(m is None)
            size += len(parts[-1])
            at = m.start() if m else None
            if size >= CHUNK:
                yield parts, owner, last
                parts, owner, last, size = [], [], [], 0
    if parts:
        yield parts, owner, last


def _writer(path: str, tokenizer: str, end_id: int | None, special_as_text: bool) -> Callable:
    names = ["doc_id", "shard", "first", "n_tokens", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), _coder(tokenizer, special_as_text)
        out, first, id_now, same = None, 0, None, 0
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                if out is None:
                    out = files.Writer(f"{path}/payload/shard-{shard:05d}.bin")
                n = np.zeros(part.num_rows, np.int64)
                for texts, owner, last in _parts([t or "" for t in part.column(1).to_pylist()]):
                    ids, size = coder.encode_all(texts)
                    n += np.bincount(owner, size, len(n)).astype(np.int64)
                    if end_id is not None:
                        ends = np.cumsum(size)[np.array(last)]
                        ids = np.insert(ids, ends, end_id)
                    out.write(ids.tobytes())
                n += end_id is not None
                at = first + np.concatenate([[0], np.cumsum(n)])
                first = int(at[-1])
                ids = part.column(0).cast(pa.int64()).to_pylist()
                runs = np.zeros(len(ids), np.int64)
                for k, x in enumerate(ids):
                    same = same + 1 if x == id_now and (i or k or same) else 0
                    id_now, runs[k] = x, same
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(at[:-1]), pa.array(n), pa.array(runs)], names)
            if b.nbytes >= TRIM_BYTES:
                trim()
        if out is not None:
            out.close()

    return run


def _index_writer(path: str) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _coded()
        ids = pdf.doc_id.fillna(0).to_numpy(np.int64)
        h = key_hash(ids, pdf["copy"].to_numpy(np.int64), pdf.doc_id.isna().to_numpy())
        mph = PerfectHash.build(h)
        slot = mph.slots(h)
        if len(mph.rest):  # equal hashes: each takes a slot of its own, and lookup compares keys
            late = slot >= mph.rank[-1]
            slot[late] = mph.rank[-1] + np.arange(late.sum())
        rec = np.zeros(len(h), RECORD)
        for name, v in (("fingerprint", fingerprint(h)), ("shard", pdf.shard), ("first", pdf["first"]), ("n", pdf.n_tokens), ("doc_id", ids), ("null", pdf.doc_id.isna()), ("copy", pdf["copy"])):
            rec[name][slot] = v
        files.write(f"{path}/index/bucket-{key[0]:05d}.mph", [mph.pack(), rec.tobytes()])
        return pd.DataFrame({"bucket": [key[0]], "keys": [len(h)]})

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int | None = END_ID, special_as_text: bool = False) -> Store:
    """Writes payload and index of docs (doc_id, text) and returns the store."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = (F.xxhash64("text"), F.spark_partition_id())  # the last one only spreads equal rows
    in_order = keyed.withColumns({"tie": tie[0], "from": tie[1]}).repartitionByRange("doc_id", "tie", "from").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    written = in_order.mapInArrow(_writer(path, tokenizer, end_id, special_as_text), "doc_id long, shard int, first long, n_tokens long, run long")
    written = materialize(written, "token-rows")
    entries = carried(written, name="copy").drop("run")
    buckets = max(1, -(-written.count() // BUCKET_KEYS))
    by_bucket = entries.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "copy"), F.lit(buckets)).cast("int"))
    indexed = by_bucket.groupBy("bucket").applyInPandas(_index_writer(path), "bucket int, keys long")
    indexed.agg(F.sum("keys")).collect()  # writes the index; one number comes back
    from tokenizers import Tokenizer

    return Store(path, 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4, buckets, entries)


def _finder(store_path: str) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _coded()
        raw = files.read(f"{store_path}/index/bucket-{key[0]:05d}.mph")
        mph, at = PerfectHash.unpack(raw)
        rec = np.frombuffer(raw, RECORD, -1, at)
        ids, copy, null = pdf.doc_id.fillna(0).to_numpy(np.int64), pdf["copy"].to_numpy(np.int64), pdf.doc_id.isna().to_numpy()
        h = key_hash(ids, copy, null)
        slot = mph.slots(h)
        ok = slot >= 0
        ok[ok] = rec["fingerprint"][slot[ok]] == fingerprint(h[ok])
        late = rec[mph.rank[-1] :]  # keys whose hashes are equal, if any: whole keys are compared
        for i in np.flatnonzero(ok & (slot >= mph.rank[-1])):
            same = np.flatnonzero((late["doc_id"] == ids[i]) & (late["null"] == null[i]) & (late["copy"] == copy[i]))
            ok[i], slot[i] = len(same) > 0, mph.rank[-1] + same[0] if len(same) else -1
        r = rec[slot[ok]]
        return pd.DataFrame({"doc_id": pdf.doc_id[ok], "copy": copy[ok], "shard": r["shard"].astype(np.int32), "first": r["first"].astype(np.int64), "n_tokens": r["n"].astype(np.int64)})

    return run


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """Payload ranges of keys (doc_id, copy) that the index holds: doc_id, copy, shard, first, n_tokens."""
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "copy"), F.lit(store.buckets)).cast("int")
    return keys.select("doc_id", "copy", bucket.alias("bucket")).groupBy("bucket").applyInPandas(_finder(store.path), "doc_id long, copy long, shard int, first long, n_tokens long")


def read_ids(store: Store, found: DataFrame, schema: str, digest: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Reads each range from its shard and adds what digest makes of the ids (uint32); schema has the names and types of that."""
    names = [x.split()[0] for x in schema.split(",")]
    path, dtype = store.path, np.dtype("<u2") if store.width == 2 else np.dtype("<u4")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _coded()
        at, reader = None, None
        for pdf in frames:
            out = []
            for shard, first, n in zip(pdf.shard, pdf["first"], pdf.n_tokens, strict=True):
                if shard != at:
                    if reader:
                        reader.close()
                    at, reader = shard, files.Reader(f"{path}/payload/shard-{shard:05d}.bin")
                raw = reader.at(int(first) * dtype.itemsize, int(n) * dtype.itemsize)
                out.append(digest(np.frombuffer(raw, dtype).astype("<u4")))
            for k, name in enumerate(names):
                pdf[name] = [x[k] for x in out]
            yield pdf
        if reader:
            reader.close()

    return found.repartition(F.col("shard"), F.floor(F.col("first") / F.lit(1 << 22))).sortWithinPartitions("shard", "first").mapInPandas(run, f"doc_id long, copy long, shard int, first long, n_tokens long, {schema}")


def shard_starts(store: Store) -> DataFrame:
    """shard, base: ids in all shards before it. One row for each shard."""
    per = store.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store of docs, finds every document through the index and reads its ids back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    store = write_store(docs, tokenizer)
    found = lookup(store, store.entries.select("doc_id", "copy"))
    rows = read_ids(store, found, "ids_crc32 long", lambda ids: (zlib.crc32(ids.tobytes()),))
    return rows.join(shard_starts(store), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))
