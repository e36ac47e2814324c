"""MinHash near-dedup with circulant permutations.

A document's set holds the hashes of its distinct word shingles. One permutation (a scrambling of the hash) places each shingle on a
circle of 2^20 places; a second one ranks the places. Signature coordinate k is the smallest rank over the document's
places shifted by k: two permutations give all coordinates. ROWS coordinates form a band; documents that agree in a band share a bucket.

1. Documents with equal sets form a class; its smallest id stands for it from here on.
2. A pair of classes that share a bucket is plausible if their sizes and one bit of each of 128 coordinates allow the similarity. Groups are the
   components of all plausible pairs. Most come from pairing each class with the smallest and the largest id of each of its buckets; where groups still
   meet in a bucket, all its pairs of different groups are tested too: by a join in buckets of up to SMALL classes, block against block in larger ones.
3. A group is dealt into blocks bounded by documents and bytes; all pairs within a block are verified on full sets. Of a group of several blocks, one
   root of each tree of links is dealt and verified again, until a group's roots meet in one block or few links are new. Blocks of which members are in different components still, and
   plausible, are verified against each other.
4. Components of all links; the smallest id names a component.

Candidates miss a pair at similarity 0.8 with probability (1 - 0.8^5)^32 = 3e-6, less above it. The plausibility test refuses a pair at 0.8
when over 34 of 128 bits differ; 13 are expected (6 standard deviations). A test measures the recall of both. Sets of over about a million shingles
saturate the circle: such documents meet each other in every bucket and only size and full sets tell them apart.

Hot groups: equal sets collapse before anything is paired; stars have as many pairs as members; buckets are pre-aggregated and joined, never gathered,
so adaptive execution can split a hot one. A comparison of blocks sends out only pairs that join trees, no more than it has members. A group of near copies
that link through their representatives costs as many set comparisons as BLOCK times its members; only members of components that stay apart
and look plausible are compared block against block.

Defined results: null and empty texts have an empty set (n_shingles 0), link with nothing and are kept. Fewer words than `width`: the whole sequence is one
shingle. A null id links with nothing and is kept. Rows with the same id are one document: it has the links of all of them. Empty tables give
empty results. Words are split at ASCII white space; only A-Z are lower-cased. Other columns are ignored (classes) or kept (deduplicate).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.graph import components
from pagewright.llm.textbatch import LOWER, find_words, pieces, rolling, scramble
from pagewright.session import materialize, table

BANDS, ROWS, CIRCLE = 32, 5, 1 << 20
COORDINATES = BANDS * ROWS
MOST_BITS = 34
#: Most documents, and about most bytes of sets, in a block; classes that a bucket's join takes; classes in a block of descriptions.
BLOCK, BLOCK_BYTES, SMALL, WIDE = 256, 64 << 20, 64, 1024
U = np.uint64


@functools.cache
def _ranks() -> np.ndarray:
    """Row i: the ranks of COORDINATES places from place i on (a view; nothing is copied)."""
    rank = np.argsort(scramble(np.arange(CIRCLE, dtype=U) ^ U(0x5851F42D4C957F2D)), kind="stable").astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:COORDINATES]]), COORDINATES)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a set that isn't empty."""
    place = (scramble(hashes ^ U(0x2545F4914F6CDD1D)) >> U(44)).astype(np.int64)
    ranks, out = _ranks(), None
    for i in range(0, len(place), 4096):
        low = ranks[place[i : i + 4096]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each document's sorted set of shingle hashes."""
    w = find_words(LOWER[buf], off)
    h = w.hashes()
    runs = {k: rolling(h, k) + U(k) for k in range(1, width + 1)} if len(h) else {}
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        k = min(width, z - a)
        yield np.unique(runs[k][a : z - k + 1]) if k else np.zeros(0, U)


_BAND = scramble(np.arange(1, BANDS + 1, dtype=U))


def _describe(s: np.ndarray) -> tuple:
    """n, two hashes of the set, 128 bits, band keys."""
    if not len(s):
        return 0, None, None, None, None, None
    sig = signature(s)
    key = _BAND.copy()
    for j in range(ROWS):
        key = scramble(key + sig[j::ROWS].astype(U))
    bits = np.packbits(sig[:128].astype(np.uint8) & 1).view(np.int64)
    with np.errstate(over="ignore"):
        k1, k2 = scramble(s).sum(dtype=U), scramble(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=U)
    return len(s), int(k1.view(np.int64)), int(k2.view(np.int64)), int(bits[0]), int(bits[1]), key.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2, b0, b1, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(1)):
                cols = list(zip(*(_describe(s) for s in shingle_sets(buf, off, width)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "k1", "k2", "b0", "b1", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, b0 long, b1 long, bands array<long>")


class _Forest:
    """Union-find over a few documents; keeps the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[b] = a
            self.edges.append((i, j))


def _similar(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all similar ones; members of right are numbered behind those of left. right None: left with itself."""
    other = left if right is None else right
    size = np.array([len(x) for x in other])
    if not size.sum():
        return []
    h = np.concatenate(other)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], np.repeat(np.arange(len(other)), size)[order]
    shift = 0 if right is None else len(left)
    forest = _Forest(shift + len(other))
    for i, x in enumerate(left):
        if not len(x):
            continue
        lo = np.searchsorted(h, x, "left")
        n = np.searchsorted(h, x, "right") - lo
        both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(other))
        for j in np.flatnonzero((100 * both >= percent * (len(x) + size - both)) & (both > 0)).tolist():
            if right is not None or j > i:
                forest.join(i, shift + j)
    return forest.edges


def _unpack(data: bytes, sizes: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(data, U), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])


def _blocks(groups: DataFrame, turn: int) -> DataFrame:
    """groups (doc_id, g, n_shingles) with a block and the number of blocks of each group, bounded by documents and bytes."""
    size = groups.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
    return groups.join(size, "g").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(turn)), "blocks"))


def _within(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Of members (g, block, blocks, doc_id, members) the links inside each block as (g, blocks, a, b); of groups of several blocks, and of all after the first turn, also a row (g, blocks, a, null, block, root, members) for each member: root says that it stands for what it is linked with."""
    schema = "g long, blocks long, a long, b long, block long, root boolean, members binary"
    names = [x.split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        out, held = [], 0
        for (g, block, blocks), mine in groupby(rows, key=lambda r: r[:3]):
            mine = list(mine)
            edges = _similar([np.frombuffer(r[4], U) for r in mine], None, percent)
            out += [(g, blocks, mine[i][3], mine[j][3], None, None, None) for i, j in edges]
            if turn or blocks > 1:
                forest = _Forest(len(mine))
                for i, j in edges:
                    forest.join(i, j)
                out += [(g, blocks, r[3], None, block, forest.root(i) == i, r[4]) for i, r in enumerate(mine)]
                held += sum(len(r[4]) for r in mine)
            if len(out) > 5000 or held > 1 << 24:
                yield pd.DataFrame(out, columns=names).astype({"b": "Int64", "block": "Int64"})
                out, held = [], 0
        yield pd.DataFrame(out, columns=names).astype({"b": "Int64", "block": "Int64"})

    dealt = members.select("g", "block", "blocks", "doc_id", "members").repartition("g", "block").sortWithinPartitions("g", "block")
    return dealt.mapInPandas(run, schema)


def verified(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of similar full sets among the documents of each group (node, component, n_shingles): enough of them to connect all that are similar."""
    placed = materialize(_blocks(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("g"), "n_shingles"), 0).drop("n_shingles"), "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(4)):
                members = pa.array([s.tobytes() for s in shingle_sets(buf, off, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:4]), members], ["g", "block", "blocks", "doc_id", "members"])

    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed, "doc_id").select("g", "block", "blocks", "doc_id", "text").mapInArrow(sets, "g long, block long, blocks long, doc_id long, members binary")
    first = materialize(_within(members, percent, 0), "verified")
    found = first.where("b is not null").select("a", "b")
    if not first.where("b is null").limit(1).count():
        return found
    return found.unionByName(_large(first, percent))


def _large(first: DataFrame, percent: int) -> DataFrame:
    """More links (a, b) of groups of several blocks: roots are dealt and verified until a group's meet in one block or few are linked; what stays apart is compared between blocks."""
    links_, found, turn = first.where("b is not null and blocks > 1").select("g", "a", "b"), None, 0
    roots = first.where("root")
    apart, n = None, roots.count()
    while n:
        turn += 1
        dealt = _blocks(roots.select("g", F.col("a").alias("doc_id"), "members", F.expr("length(members) div 8").alias("n_shingles")), turn)
        now = materialize(_within(dealt, percent, turn), "roots")
        new = now.where("b is not null").select("g", "a", "b")
        found = new if found is None else found.unionByName(new)
        left = now.where("root")
        many = left.count()
        # Of groups whose roots met in one block, and of all when few roots were linked, those of several roots stay apart.
        over = left if 10 * many > 9 * n else left.where("blocks = 1")
        over = over.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
        apart = over if apart is None else apart.unionByName(over)
        if 10 * many > 9 * n:
            break
        roots = left.where("blocks > 1")
        n = roots.count()
    if apart is None:
        return links_.select("a", "b").limit(0)
    apart = materialize(apart, "apart")
    if not apart.limit(1).count():
        return found.select("a", "b")
    label = components(links_.unionByName(found).join(apart, "g", "left_semi").select("a", "b"))
    members = first.where("b is null").join(apart, "g", "left_semi").select("g", "block", F.col("a").alias("doc_id"), "members")
    named = members.join(label, F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component")
    return found.select("a", "b").unionByName(materialize(_between(named, percent), "links"))


def _between(named: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (g, block, doc_id, members, c) of different blocks and components. Blocks' bits are compared first; sets of blocks without a plausible pair aren't."""
    info = "g long, block long, ids binary, sizes binary, labels binary, bits binary, data binary"
    names = [x.split()[0] for x in info.split(",")]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        for (g, block), mine in groupby(rows, key=lambda r: r[:2]):
            mine = list(mine)
            bits = b"".join(np.packbits(signature(np.frombuffer(r[4], U))[:128].astype(np.uint8) & 1).tobytes() for r in mine)
            n = np.array([len(r[4]) // 8 for r in mine], np.int64)
            yield pd.DataFrame([(g, block, np.array([r[2] for r in mine], np.int64).tobytes(), n.tobytes(), np.array([r[3] for r in mine], np.int64).tobytes(), bits, b"".join(r[4] for r in mine))], columns=names)

    packed = named.select("g", "block", "doc_id", "c", "members").repartition("g", "block").sortWithinPartitions("g", "block").mapInPandas(pack, info)
    packed = materialize(packed, "packed")
    light = packed.select("g", "block", "sizes", "labels", "bits")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for r in f.itertuples(index=False):
                n, m = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.sizes_2, np.int64)
                x, y = np.frombuffer(r.bits, U).reshape(-1, 2), np.frombuffer(r.bits_2, U).reshape(-1, 2)
                c, d = np.frombuffer(r.labels, np.int64), np.frombuffer(r.labels_2, np.int64)
                keep.append(bool((_near(n, x, m, y, percent) & (c[:, None] != d)).any()))
            yield f.loc[keep, ["g", "block", "block_2"]]

    other = light.toDF("g", "block_2", "sizes_2", "labels_2", "bits_2")
    met = light.join(other, "g").where("block < block_2").repartition("g", "block", "block_2").mapInPandas(meet, "g long, block long, block_2 long")
    met = materialize(met, "met")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids = np.concatenate([np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids_2, np.int64)])
                found = np.array(_similar(_unpack(r.data, r.sizes), _unpack(r.data_2, r.sizes_2), percent), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    sets = packed.select("g", "block", "ids", "sizes", "data")
    return met.join(sets, ["g", "block"]).join(sets.toDF("g", "block_2", "ids_2", "sizes_2", "data_2"), ["g", "block_2"]).mapInPandas(compare, "a long, b long")


def _near(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of descriptions (sizes, two words of bits) are plausible."""
    differ = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]) + np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
    return (differ <= MOST_BITS) & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m))


def _wide_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of components (a, b) that are to be one, of rows (band, c, n_shingles, b0, b1, blocks): each bucket's plausible pairs, block against block; a comparison gives pairs that join trees."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("c", "b0", "b1"), "blocks"))
    schema = "band long, block long, labels binary, sizes binary, bits binary"

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_ = (r for f in frames for r in f.itertuples(index=False, name=None))
        for (band, block), mine in groupby(rows_, key=lambda r: r[:2]):
            v = np.array([r[2:] for r in mine], np.int64)
            yield pd.DataFrame([(band, block, v[:, 0].tobytes(), v[:, 1].tobytes(), np.ascontiguousarray(v[:, 2:]).tobytes())], columns=["band", "block", "labels", "sizes", "bits"])

    packed = materialize(placed.select("band", "block", "c", "n_shingles", "b0", "b1").repartition("band", "block").sortWithinPartitions("band", "block").mapInPandas(pack, schema), "packed")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                c, d = np.frombuffer(r.labels, np.int64), np.frombuffer(r.labels_2, np.int64)
                n, m = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.sizes_2, np.int64)
                x, y = np.frombuffer(r.bits, U).reshape(-1, 2), np.frombuffer(r.bits_2, U).reshape(-1, 2)
                names, at = np.unique(np.concatenate([c, d]), return_inverse=True)
                forest = _Forest(len(names))
                for i in range(0, len(c), 256):
                    near = _near(n[i : i + 256], x[i : i + 256], m, y, percent) & (c[i : i + 256, None] != d)
                    p, q = np.nonzero(near)
                    for k in np.unique(at[i + p] * len(names) + at[len(c) + q]).tolist():
                        forest.join(*divmod(k, len(names)))
                yield pd.DataFrame([(names[p], names[q]) for p, q in forest.edges], columns=["a", "b"])

    pairs = packed.join(packed.toDF("band", "block_2", "labels_2", "sizes_2", "bits_2"), "band").where("block <= block_2")
    return pairs.repartition("band", "block", "block_2").mapInPandas(meet, "a long, b long")


def _plausible(x: str, y: str, percent: int) -> F.Column:
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differ(x, y) <= MOST_BITS)


def _differ(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))) + F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1")))


def candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """Components (node, component) of all plausible pairs of classes (doc_id, n_shingles, b0, b1, bands) that share a bucket."""
    me = F.struct("doc_id", "n_shingles", "b0", "b1")
    rows = reps.select(F.explode("bands").alias("band"), me.alias("x"))
    # Written, so that both sides of the join are plain shuffles and a hot bucket's rows can be split.
    hubs = materialize(rows.groupBy("band").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    stars = rows.join(hubs, "band").select("x", F.explode(F.array("lo", "hi")).alias("hub")).where("x.doc_id <> hub.doc_id").where(_plausible("x", "hub", percent))
    # A class has at most two hubs a band. An edge to the first, and edges from that to the others, which members of a group have in common, connect the same.
    own = stars.groupBy(F.col("x.doc_id").alias("child")).agg(F.array_sort(F.collect_set("hub.doc_id")).alias("hubs"))
    first = F.element_at("hubs", 1)
    edges = own.select(F.explode(F.transform("hubs", lambda h: F.struct(first.alias("a"), F.when(h == first, F.col("child")).otherwise(h).alias("b")))).alias("e")).select("e.*").distinct()
    comp = components(edges)
    # Buckets in which groups still meet.
    known = reps.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.explode("bands").alias("band"), me.alias("x"), F.coalesce("component", "doc_id").alias("c"))
    sizes = known.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1").drop("parts")
    open_ = materialize(known.join(materialize(sizes, "open"), "band"), "buckets")
    few = open_.where(F.col("n") <= SMALL)
    left = few.where("c <> main").select("band", F.col("x").alias("y"), F.col("c").alias("d"))
    more = left.join(few, "band").where((F.col("c") != F.col("d")) & ((F.col("c") == F.col("main")) | (F.col("x.doc_id") < F.col("y.doc_id")))).where(_plausible("x", "y", percent)).select(F.col("c").alias("a"), F.col("d").alias("b"))
    many = open_.where(F.col("n") > SMALL).select("band", "c", "x.n_shingles", "x.b0", "x.b1", F.ceil(F.col("n") / WIDE).alias("blocks"))
    more = materialize(more.unionByName(_wide_buckets(many, percent)).distinct(), "pairs")
    if not more.limit(1).count():
        return comp
    lone = more.select(F.explode(F.array("a", "b")).alias("b")).select(F.col("b").alias("a"), "b")
    over = components(more)
    named = comp.unionByName(lone.select(F.col("a").alias("node"), F.col("b").alias("component"))).distinct()
    return named.join(over.toDF("component", "over"), "component", "left").select("node", F.coalesce("over", "component").alias("component"))


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of class representatives that have a link: node, component."""
    groups = materialize(candidate_groups(reps, percent).join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node"), "groups")
    return components(materialize(verified(groups, docs, width, percent), "links"))


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    sig = materialize(signatures(docs, width), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    cls = materialize(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "b0", "b1", "bands")).alias("r")).select("k1", "k2", "r.*"), "classes")
    # Rows with the same id are one document: its classes are linked.
    same = some.join(cls.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"]).select("doc_id", "rep")
    comp = links(docs, cls.drop("k1", "k2"), width, percent)
    twins = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    twins = materialize(twins, "twins")
    if twins.limit(1).count():
        all_ = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b")))
        comp = components(materialize(all_, "links"))
    named = cls.select("k1", "k2", F.col("doc_id").alias("rep")).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    cid = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; their columns. Of rows with the same id the one whose text has the smallest hash stays; rows without an id all stay.

    Only rows whose id is repeated are regrouped, and reduced before they are shuffled, so neither null ids nor a hot one meet in a task.
    """
    gone = near_classes(docs, width, percent).where("not kept").select("doc_id").distinct()
    left = docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    twice = materialize(ids.where("__rows > 1").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return left
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("__one")).select("__one.*")
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), width=2)


#: Exact, by way of the rarest shingles: similar sets share one among each set's first n - ceil(0.8 n) + 1.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM w
), c AS (
  SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (
  SELECT rep, n, unnest(sh) AS g FROM c
), f AS (
  SELECT g, count(*) AS df FROM e GROUP BY g
), o AS (
  SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY df, g) AS r FROM e JOIN f USING (g)
), p AS (
  SELECT rep, n, g FROM o WHERE r <= n - (4 * n + 4) // 5 + 1
), pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS (
  SELECT a, b, x.n + y.n AS n, len(list_intersect(x.sh, y.sh)) AS i FROM pairs JOIN c x ON x.rep = a JOIN c y ON y.rep = b
), linked AS (
  SELECT a, b FROM l WHERE 100 * i >= 80 * (n - i) UNION ALL SELECT b, a FROM l WHERE 100 * i >= 80 * (n - i)
), reach AS (
  SELECT rep AS node, rep AS m FROM c UNION SELECT b, m FROM reach JOIN linked ON a = node
), comp AS (
  SELECT node, min(m) AS component FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN comp ON node = rep
"""
