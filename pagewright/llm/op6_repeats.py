"""Substring dedup on a compacted de Bruijn graph of words.

A run of WINDOW words is an edge from the node of its first WINDOW - 1 words to that of its last. An edge that occurs twice is a repeat; its occurrence
with the smallest (doc_id, start) is the source, and the words that any other occurrence covers go.

1. Consecutive edges of a document that share a minimizer (the smallest hash among their runs of ANCHOR words) form a piece; equal edges
   have equal minimizers, so all occurrences of an edge lie in pieces of the same minimizer. Pieces are counted by minimizer; those of a minimizer
   that occurs once hold no repeat and leave the graph. That is most of them.
2. Where a minimizer's pieces differ or cross themselves, the graph branches inside them. Of equal such pieces only the first occurrence stays in the graph: every edge of another
   occurrence starts earlier in the first, so the other goes whole, and it can't be the source of an edge. The first ones are cut into single edges with 128-bit hashes, and edges that occur once leave.
3. Nodes between pieces: each occurrence of a piece knows the piece that enters its first node and the one that leaves its last node in its document. From these
   every piece's in- and out-degree is counted. Where all occurrences of a piece lead to one other piece, and all occurrences of that one come from it, the node between does not
   branch: a join of the pieces' degrees finds these, a second join marks them at all occurrences, and pieces that go on across such nodes are one path.
4. All occurrences of a compacted path are equal and whole. Its source coordinates are its smallest (doc_id, start); an occurrence elsewhere that has the same
   length and pieces is verified as a copy and is a removed span.
5. Overlapping and touching spans of a document merge, and the words left are joined again.

Scale: per seven words one piece of about 30 bytes is shuffled, twice; what repeats has a number instead of its hashes from there on, is sorted by document once and joined by piece. Texts are shuffled by doc_id once, and again only
for documents with repeats. Counts are pre-aggregated; joins have one unique side and both are written first, so adaptive execution can split a hot
key. A document's pieces are gathered (never more than its words). No step follows a path piece by piece: where a link holds, it holds at every occurrence, so paths come whole.

Pieces are compared by a 64-bit hash beside their 64-bit minimizer, edges by two 64-bit hashes: 128 bits, so that an accidental match
is less likely than 1e-9 even among 10^14 edges.

Defined results: null and empty texts have no words and keep the hash of the empty text. Texts of fewer words than the window lose nothing.
If an id is null or occurs twice, documents are ordered by id (nulls first), then by a hash of their text, then as they come, and each counts
as a document of its own; so of equal rows one stays. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.textbatch import WORD_BASE_2, find_words, pieces, rolling, span_hash
from pagewright.session import materialize, remove, table, written

WINDOW, ANCHOR = 20, 8
U = np.uint64
I64 = np.int64


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        a = np.minimum(a[: len(a) - span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def _pieces(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Pieces of a batch: doc, start (both within the batch), n edges, minimizer, content hash, whether it may cross itself."""
    n = len(h) - window + 1
    if n <= 0:
        return {k: np.zeros(0, t) for k, t in (("doc", I64), ("start", I64), ("n", I64), ("key", U), ("content", U), ("loop", bool))}
    m = rolling(h, anchor)
    low = _sliding_min(m, window - anchor + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = doc[:n] == doc[window - 1 :]
    new = ok.copy()
    new[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]) & (doc[1:n] == doc[: n - 1]))
    begin = np.flatnonzero(new)
    last = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
    size = last - begin + 1
    key = low[begin]
    span = size + window - anchor
    at = np.cumsum(span) - span
    where = np.repeat(begin - at, span) + np.arange(int(span.sum()))
    loop = np.add.reduceat(m[where] == np.repeat(key, span), at, dtype=np.int32) > 1 if len(at) else np.zeros(0, bool)
    return {"doc": doc[begin], "start": begin, "n": size, "key": key, "content": span_hash(h, begin, begin + size + window - 1, WORD_BASE_2), "loop": loop}


def pieces_of(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, doc_id, start, n, content, loop: one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, buf, off in pieces(b.column(1)):
                w = find_words(buf, off)
                p = _pieces(w.hashes(), w.first, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["key"].view(I64)), pa.array(ids[p["doc"] + i]), pa.array((p["start"] - w.first[p["doc"]]).astype(np.int32)), pa.array(p["n"].astype(np.int32)), pa.array(p["content"].view(I64)), pa.array(p["loop"])],
                    ["key", "doc_id", "start", "n", "content", "loop"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, start int, n int, content long, loop boolean")


def _removed(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.zeros(size + 1, I64)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark)[:size] > 0


def _hits(col: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs (null lists: empty)."""
    n = np.array([len(v) if v.is_valid else 0 for v in col]) if col.null_count else np.diff(col.offsets.to_numpy())
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(n)]).astype(I64), [flat.field(flat.type.get_field_index(k)).to_numpy(zero_copy_only=False).astype(I64) for k in names]


def _kept(raw: bytes, gone: np.ndarray | None) -> tuple[int, int, str]:
    words = raw.split()  # of bytes: at ASCII white space
    if gone is not None:
        left = compress(words, (~gone).tolist())
    return len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(b" ".join(words if gone is None else left)).hexdigest()


_SETTLED = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, edges array<struct<h1:long,h2:long,start:int>>"


def _settle(window: int):
    """Rows of doc_id, text, hits (pieces at branches; null where nothing of the document repeats): the result, or the text and the edges of those pieces."""
    edge = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(1)):
                part = b.slice(i, j - i)
                at, (start, n) = _hits(part.column(2), ("start", "n"))
                some, w = np.asarray(part.column(2).is_valid()), None
                rows: list[tuple] = []
                for d in range(j - i):
                    raw = buf[off[d] : off[d + 1]].tobytes()
                    if not some[d]:
                        rows.append((*_kept(raw, None), None, None))
                        continue
                    bs, bn = start[at[d] : at[d + 1]], n[at[d] : at[d + 1]]
                    if not len(bs):
                        rows.append((None, None, None, raw.decode(), None))
                        continue
                    if w is None:
                        w = find_words(buf, off)
                        h = w.hashes()
                        h1, h2 = rolling(h, window), rolling(h, window, WORD_BASE_2)
                    lead = np.cumsum(bn) - bn
                    place = np.repeat(bs - lead, bn) + np.arange(int(bn.sum()))
                    x, y = h1[w.first[d] + place], h2[w.first[d] + place]
                    rows.append((None, None, None, raw.decode(), pa.StructArray.from_arrays([pa.array(x.view(I64)), pa.array(y.view(I64)), pa.array(place.astype(np.int32))], fields=list(edge))))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), _lists(cols[4], edge)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "edges"],
                )

    return run


def _lists(values: tuple, kind: pa.DataType) -> pa.Array:
    """Lists of structs from struct arrays or None."""
    size = [0 if v is None else len(v) for v in values]
    off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    have = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(off, pa.concat_arrays(have) if have else pa.array([], kind), mask=pa.array([v is None for v in values]))


def _finish(window: int):
    """Rows of doc_id, text, spans (first edge, number of edges) that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            at, (start, n) = _hits(b.column(2), ("start", "n"))
            for d in range(b.num_rows):
                raw = b.column(1)[d].as_py().encode()
                s = start[at[d] : at[d + 1]]
                rows.append(_kept(raw, _removed(len(raw.split()), s, s + n[at[d] : at[d + 1]] + window - 1) if len(s) else None))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with ids that occur once, in the order of (doc_id, text's hash); the second frame leads back (None: ids stay)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs, None
    tie = F.xxhash64("text")
    ranked = docs.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie).withColumn("own", F.monotonically_increasing_id())
    ranked = materialize(ranked, "ranked")
    return ranked.select(F.col("own").alias("doc_id"), "text"), ranked.select(F.col("own"), F.col("doc_id").alias("given"))


def compacted(parts: DataFrame, scratch: list[str] | None = None, me: Column | None = None) -> DataFrame:
    """Of occurrences of pieces (p1, p2: the piece; doc_id, start, n: edges of the document) those of compacted paths: doc_id, start, n, h1, h2 (the first piece), n_pieces, chain (a hash of its pieces).

    The tables that it writes and its rows are read from are named in scratch. me: a long of p1 and p2 that no two pieces share, a hash of both if not given.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        table_, at = written(df, name)
        if scratch is not None:
            scratch.append(at)
        return table_

    in_doc, mixed = Window.partitionBy("doc_id").orderBy("start"), F.xxhash64("p1", "p2")
    me = mixed if me is None else me
    near = F.struct(me.alias("id"), "start", "n")
    steps = parts.withColumns({"b": F.lag(near).over(in_doc), "f": F.lead(near).over(in_doc)})
    before, after = F.when(F.expr("b.start + b.n = start"), F.col("b.id")), F.when(F.expr("f.start = start + n"), F.col("f.id"))
    steps = kept(steps.select("p1", "p2", "doc_id", "start", "n", before.alias("before"), after.alias("after")), "steps")
    seen = [f(c).alias(f"{name}_{c}") for c in ("before", "after") for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    degrees = steps.groupBy("p1", "p2").agg(F.count("*").alias("times"), *seen)
    only = {c: F.when(F.expr(f"n_{c} = times and lo_{c} = hi_{c}"), F.col(f"lo_{c}")) for c in ("before", "after")}
    nodes = kept(degrees.select("p1", "p2", only["before"].alias("enters"), only["after"].alias("leaves")).where("enters is not null or leaves is not null"), "degrees")
    ahead = nodes.where("leaves is not null").select(me.alias("enters"), F.col("leaves").alias("id"))
    links = kept(nodes.where("enters is not null").select("p1", "p2", me.alias("id"), "enters").join(ahead, ["enters", "id"]).select("p1", "p2", F.lit(True).alias("goes_on")), "links")
    marked = steps.select("p1", "p2", "doc_id", "start", "n").join(links, ["p1", "p2"], "left").withColumn("path", F.sum(F.col("goes_on").isNull().cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("doc_id", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min_by(F.struct("p1", "p2"), "start").alias("p"), F.count("*").alias("n_pieces"), F.bit_xor(mixed).alias("chain"))
    return whole.select("doc_id", "start", "n", F.col("p.p1").alias("h1"), F.col("p.p2").alias("h2"), "n_pieces", "chain")


def _first_marked(whole: DataFrame) -> DataFrame:
    """doc_id, start, n, first of occurrences of pieces (id, content: the piece): whether each is its piece's first by (doc_id, start)."""
    piece = ["id", "content"]
    lead, lead_at = written(whole.groupBy(*piece).agg(F.min(F.struct("doc_id", "start")).alias("lead")), "lead")
    marked = materialize(whole.join(lead, piece).select("doc_id", "start", "n", F.expr("doc_id = lead.doc_id and start = lead.start").alias("first")), "marked")
    remove(whole.sparkSession, lead_at)
    return marked


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs, back = _in_order(docs)
    spark, number = docs.sparkSession, F.monotonically_increasing_id().alias("id")
    # lo and hi first: side by side with the key they take less in a shuffle.
    counts = pieces_of(docs, window, anchor).groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.count("*").alias("times"), F.max("loop").alias("loop"))
    # Written, so that both sides of the join are plain shuffles and a hot key's rows can be split.
    repeated, repeated_at = written(counts.where("times > 1 or loop").select("key", number, ((F.col("lo") != F.col("hi")) | F.col("loop")).alias("branch")), "repeated")
    hits = pieces_of(docs, window, anchor).select("key", "content", "doc_id", "start", "n").join(repeated, "key")
    hits, hits_at = written(hits.select("id", "branch", F.when(F.col("branch"), F.col("content")).alias("content"), "doc_id", "start", "n"), "hits")
    remove(spark, repeated_at)
    marked = _first_marked(hits.where("branch").select("id", "content", "doc_id", "start", "n"))
    seen = hits.where("not branch").select("doc_id", F.lit(None).cast("struct<start:int,n:int>").alias("hit"))
    listed = seen.unionByName(marked.select("doc_id", F.when(F.col("first"), F.struct("start", "n")).alias("hit"))).groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))
    settled = materialize(docs.join(listed, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(_settle(window), _SETTLED), "settled")
    done = settled.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    edges = settled.where("text is not null").select("doc_id", F.inline("edges"))
    twice, twice_at = written(edges.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2", number), "twice")
    cut = edges.join(twice, ["h1", "h2"]).select("id", F.lit(1).cast("long").alias("p2"), "doc_id", "start", F.lit(1).alias("n"))
    plain = hits.where("not branch").select("id", F.lit(0).cast("long").alias("p2"), "doc_id", "start", "n")
    scratch = [hits_at, twice_at]
    found = materialize(compacted(plain.unionByName(cut).withColumnRenamed("id", "p1"), scratch, F.expr("2 * p1 + p2")), "paths")
    for at in scratch:  # found is written: nothing reads these again
        remove(spark, at)
    path = ["h1", "h2", "n", "chain"]
    source = materialize(found.groupBy(*path).agg(F.min(F.struct("doc_id", "start")).alias("source")), "sources")
    copies = found.join(source, path).where("doc_id <> source.doc_id or start <> source.start")
    copies = copies.select("doc_id", "start", "n").unionByName(marked.where("not first").select("doc_id", "start", "n"))
    gone = copies.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    late = settled.where("text is not null").select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", "text", "spans")
    out = done.unionByName(late.mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
    if back is None:
        return out
    return out.withColumnRenamed("doc_id", "own").join(back, "own").select(F.col("given").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), e AS (
  SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+19], ' ')) AS h FROM e
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM dup GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS r,
         CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(g, j)) END AS ks
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
"""
