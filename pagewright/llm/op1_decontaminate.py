"""Benchmark decontamination by spaced seeds.

Tokens are runs of ASCII letters and digits and of all non-ASCII characters; A-Z and the capitals of Latin-1 count as small letters.
A seed is a fixed mask: tokens under its 1s are hashed, those under its 0s are ignored. Seeds of the benchmark are joined to seeds at
every token position of every document. A hit fixes an alignment (document position - item position); around it the whole item is
compared token by token. An alignment counts if WINDOW consecutive tokens of the item have at least NEED equal tokens in place
(80 % or more). Items of fewer than WINDOW tokens count if all their tokens are equal; items of fewer than SHORTEST tokens never do.

The two long masks together hit every window of 13 tokens with up to two substitutions (all 78 pairs of places; a test goes through them),
so no such window is missed. A token is compared by its 64-bit hash.

Repetitive texts: equal seeds in a row, on either side, are one run, and two runs that meet give an interval of alignments, so every alignment is listed once. Alignments are
compared PART item tokens at a time; once one of a document and item is equal in all tokens, later ones of that pair can't be better and are left out.
At worst (items that nearly match everywhere) an item's tokens times the document's are compared, in bounded memory.

Scale: the benchmark is the stated query set. It is taken in blocks of a bounded size (BLOCK_BYTES of text); a block's
seeds are broadcast and each block makes one pass over all documents. Documents are never shuffled and a batch's memory is bounded.

Null texts on either side match nothing; null ids are carried like others. Repeated benchmark rows count once; repeated document rows each
give their rows. Equally good alignments of a document and item: the first in the document counts. Empty tables give empty results;
other columns are ignored (matches) or kept (decontaminate).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.textbatch import LOWER, PUNCT, find_words, pieces, scramble
from pagewright.session import table

WINDOW, NEED, SHORTEST = 13, 11, 5
LONG_MASKS, SHORT_MASKS = ("11101011", "11001111"), ("11111",)
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
PART = 1 << 20
U = np.uint64


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, and each document's first token (one more at the end)."""
    low = LOWER[buf]
    if len(buf):
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[latin] += 0x20
    w = find_words(low, off, PUNCT)
    return w.hashes(), w.first


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask at each position that has room for it (also across documents; the caller leaves those out)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(len(mask)))
    for j, c in enumerate(mask):
        if c == "1":
            out *= U(0xD1342543DE82EF95)
            out += h[j : j + n]
    return scramble(out)


def _runs(at: np.ndarray, seed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring places with equal seeds and owners: where each begins in at, and how many places follow its first."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(at))) - 1


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of sizes whose sum is at most PART, or one size."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + PART, "right")))
        yield a, z
        a = z


@dataclass
class Block:
    """A block of the benchmark. first: each item's first token. seed, place, more: for each mask, sorted by seed, runs of equal seeds (first place, places after it); maybe: for each mask, which top bits occur."""

    ids: list
    h: np.ndarray
    first: np.ndarray
    masks: list[str]
    seed: list[np.ndarray]
    place: list[np.ndarray]
    more: list[np.ndarray]
    maybe: list[np.ndarray]

    @classmethod
    def build(cls, ids: list, texts: list[str]) -> Block:
        raw = [t.encode() for t in texts]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        h, first = tokens(buf, off)
        size = np.diff(first)
        item = np.repeat(np.arange(len(ids)), size)
        masks, out = [], [[], [], [], []]
        for m in (*LONG_MASKS, *SHORT_MASKS):
            s = seeds(h, m)
            place = np.arange(len(s))
            mine = item[: len(s)]
            long = size[mine] >= WINDOW
            ok = (place + len(m) <= first[mine + 1]) & (long if m in LONG_MASKS else ~long & (size[mine] >= SHORTEST))
            s, place = s[ok], place[ok]
            if not len(s):
                continue
            order = np.argsort(s, kind="stable")
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[s >> U(64 - FILTER_BITS)] = True
            masks.append(m)
            s, place = s[order], place[order]
            at, more = _runs(place, s, item[place])
            for x, v in zip(out, (s[at], place[at], more, maybe), strict=True):
                x.append(v)
        return cls(ids, h, first, masks, *out)

    def find(self, buf: np.ndarray, off: np.ndarray) -> pd.DataFrame:
        """Rows (doc, item, doc_start, item_start, n_tokens, n_equal); doc and item by position."""
        h, first = tokens(buf, off)
        hits = []
        for m, seed, place, more, maybe in zip(self.masks, self.seed, self.place, self.more, self.maybe, strict=True):
            s = seeds(h, m)
            at = np.flatnonzero(maybe[s >> U(64 - FILTER_BITS)])
            at = at[seed[np.minimum(np.searchsorted(seed, s[at]), len(seed) - 1)] == s[at]]
            doc = np.searchsorted(first, at, "right") - 1
            run, after = _runs(at, s[at], doc)
            at, doc = at[run], doc[run]
            lo = np.searchsorted(seed, s[at], "left")
            n = np.searchsorted(seed, s[at], "right") - lo
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item = np.searchsorted(self.first, place[k], "right") - 1
            at, after = np.repeat(at, n), np.repeat(after, n)
            # Where the item's first token would stand: an interval for each pair of runs.
            hits.append(np.stack([np.repeat(doc, n), item, at - place[k] - more[k] + self.first[item], after + more[k] + 1]))
        if not hits or not sum(x.shape[1] for x in hits):
            return _NONE
        hits = np.concatenate(hits, axis=1)
        hits = hits[:, np.lexsort(hits[2::-1])]
        pair = np.flatnonzero(np.any(np.diff(hits[:2], axis=1, prepend=-1), axis=0))  # the first hit of each document and item
        found = [_NONE]
        for a, z in _parts(np.add.reduceat(hits[3], pair)):
            a, z = pair[a], pair[z] if z < len(pair) else hits.shape[1]
            found += self._best(h, first, hits[:, a:z])
        return pd.concat(found).sort_values(["doc", "item"], kind="stable")

    def _best(self, h: np.ndarray, first: np.ndarray, hits: np.ndarray) -> list[pd.DataFrame]:
        """Of all alignments of some documents and items the best of each pair: most equal tokens, then first in the document."""
        n = hits[3]
        which = np.repeat(np.arange(len(n)), n)
        shift = hits[2][which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc, item = hits[0][which], hits[1][which]
        order = np.lexsort((shift, item, doc))
        key = np.stack([doc[order], item[order], shift[order]])
        key = key[:, np.any(np.diff(key, axis=1, prepend=-1), axis=0) | (np.arange(key.shape[1]) == 0)]
        size = self.first[key[1] + 1] - self.first[key[1]]
        best, whole = _NONE, None
        for a, z in _parts(size):
            part = key[:, a:z]
            if whole is not None:  # the pair that the part before ended in: equal in all tokens already?
                part = part[:, (part[0] != whole[0]) | (part[1] != whole[1])]
            whole = None
            got = pd.concat([best, self._verify(h, first, *part)]) if part.shape[1] else best
            best = got.sort_values(["doc", "item", "n_equal", "doc_start"], ascending=[True, True, False, True], kind="stable").drop_duplicates(["doc", "item"])
            if len(best) and z < key.shape[1]:
                last = best[(best.doc == key[0, z]) & (best["item"] == key[1, z])]
                if len(last) and last.n_equal.iloc[0] == size[z]:
                    whole = key[:2, z]
        return [best]

    def _verify(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> pd.DataFrame:
        size = self.first[item + 1] - self.first[item]
        lead = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(lead, size)
        at = np.repeat(shift, size) + inside
        real = (at >= np.repeat(first[doc], size)) & (at < np.repeat(first[doc + 1], size))
        equal = np.zeros(len(at), bool)
        equal[real] = h[at[real]] == self.h[(np.repeat(self.first[item], size) + inside)[real]]
        c = np.concatenate([[0], np.cumsum(equal)])
        width = np.minimum(WINDOW, size)
        need = np.where(size >= WINDOW, NEED, size)
        fits = inside <= np.repeat(size - width, size)
        begin = np.flatnonzero(fits)
        owner = np.repeat(np.arange(len(size)), size)[begin]
        good = c[begin + width[owner]] - c[begin] >= need[owner]
        begin, owner = begin[good], owner[good]
        if not len(owner):
            return _NONE
        own, a = np.unique(owner, return_index=True)
        z = np.append(a[1:], len(owner)) - 1
        lo, hi = begin[a], begin[z] + width[own]
        start = lo - lead[own]
        return pd.DataFrame({"doc": doc[own], "item": item[own], "doc_start": shift[own] + start - first[doc[own]], "item_start": start, "n_tokens": hi - lo, "n_equal": c[hi] - c[lo]})


_NONE = pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc", "item", "doc_start", "item_start", "n_tokens", "n_equal")})


def _blocks(bench: DataFrame, most: int) -> Iterator[Block]:
    """The benchmark, a bounded part at a time."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))
        if rows:
            yield Block.build([r.item_id for r in rows], [r.text for r in rows])


def _over_blocks(docs: DataFrame, bench: DataFrame, most: int) -> Iterator:
    for block in _blocks(bench, most):
        yield docs.sparkSession.sparkContext.broadcast(block)


def matches(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, doc_start, item_start (tokens), n_tokens, n_equal of the overlap."""
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long"

    def runner(bc) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, buf, off in pieces(b.column(1)):
                    got = bc.value.find(buf, off)
                    if len(got):
                        ids = pa.array([bc.value.ids[k] for k in got["item"]], pa.int64())
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got["doc"].to_numpy() + i)), ids, *(pa.array(got[c].to_numpy(np.int64)) for c in ("doc_start", "item_start", "n_tokens", "n_equal"))], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        return run

    out = None
    for bc in _over_blocks(docs, bench, block_bytes):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(runner(bc), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that overlap an item; all their columns."""
    at = docs.columns.index("text")

    def runner(bc) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _, buf, off in pieces(b.column(at)):
                    keep[bc.value.find(buf, off)["doc"].to_numpy(np.int64) + i] = False
                yield b.filter(pa.array(keep))

        return run

    for bc in _over_blocks(docs, bench, block_bytes):
        docs = docs.mapInArrow(runner(bc), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_CAPITALS}', '{_SMALL}'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"


#: By all equal tokens of all alignments. Of the equal places of an alignment, NEED in a row within WINDOW make a window that counts.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, {_sql_tokens('text')} AS ws FROM documents)
), b AS (
  SELECT item_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM (SELECT item_id, ws, len(ws) AS n FROM (SELECT DISTINCT item_id, {_sql_tokens('text')} AS ws FROM benchmark WHERE text IS NOT NULL)) WHERE n >= {SHORTEST}
), e AS (
  SELECT doc_id, item_id, n, i - j AS shift, j FROM d JOIN b USING (w)
), c AS (
  SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= CASE WHEN n < {WINDOW} THEN n ELSE {NEED} END
), k AS (
  SELECT *, lag(j, {NEED - 1}) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS lo FROM c
), s AS (
  SELECT doc_id, item_id, n, shift, list(j) AS js,
         CASE WHEN n < {WINDOW} THEN 0 ELSE min(CASE WHEN j - lo < {WINDOW} THEN greatest(0, j - {WINDOW - 1}) END) END AS a,
         CASE WHEN n < {WINDOW} THEN n ELSE max(CASE WHEN j - lo < {WINDOW} THEN least(lo, n - {WINDOW}) + {WINDOW} END) END AS z
  FROM k GROUP BY doc_id, item_id, n, shift
), r AS (
  SELECT doc_id, item_id, shift + a AS doc_start, a AS item_start, z - a AS n_tokens, len(list_filter(js, lambda x: x >= a AND x < z)) AS n_equal FROM s WHERE a IS NOT NULL
)
SELECT doc_id, item_id, CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_equal AS BIGINT) AS n_equal
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start) = 1
"""
