"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting fits one shallow regression tree a round to each feature in turn (a few leaves
over the feature's bins, chosen from gradient histograms) and adds its leaf values to that feature's lookup table. Pairs whose
coarse two-way histograms explain most of what is left get tables of their own the same way. A score is the logistic of the
sum of one table entry for each feature and pair: vectorised look-ups and additions.

Features describe the text alone (byte classes, word lengths, repetition, lines, case, symbol runs); language, source, ids and labels are no inputs.

Bounds: the model is fitted on the driver on at most TRAIN_ROWS labelled rows, those with the smallest md5 of their id among all that may be
learned from; every row is scored. The ids of the training rows (at most TRAIN_ROWS) are broadcast, so texts aren't shuffled, and the features of
each come back once, so at most TRAIN_ROWS rows reach the driver. Of several texts of an id the one with the smallest hash is learned from, whatever the order of tasks.
Ids of any type are compared as text.

Null and empty texts have all features 0 and get a score like any other. Rows without label, or with a null label or id, aren't learned from;
a document with several label rows counts with each. Repeated documents are scored each. Without labels of both kinds every
score is the share of label 1 (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.textbatch import find_words, pieces, scramble
from pagewright.session import table

TRAIN_ROWS = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 6, 8, 60
LEAVES, PENALTY, LEAST_HESSIAN = 3, 2.0, 2.0

# ---------------------------------------------------------------- features

_CLASS = np.full(256, 4, np.int8)  # other ASCII
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
NAMES = ["log_bytes", "log_words", "word_len", "word_len_sd", "long_words", "short_words", "lower", "upper", "digit", "symbol", "wide", "stop", "bang", "upper_words", "symbol_words", "lone_symbols", "repeat_next", "repeat_second", "distinct", "lines_per_word", "twin_lines", "line_len_sd", "sentence_words", "symbol_run", "class_entropy"]


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    cls = _CLASS[buf]
    share = np.bincount(doc * 8 + cls, minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    w = find_words(buf, off)
    words, wdoc = w.count, w.doc()
    each = np.maximum(words, 1)
    length = (w.end - w.start).astype(np.float64)

    def per_word(v: np.ndarray) -> np.ndarray:
        return np.bincount(wdoc, v, n) / each

    mean = per_word(length)
    sd = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    has = [np.concatenate([[0], np.cumsum(cls == c, dtype=np.int32)]) for c in (1, 2, 4, 7)]
    low, up, sym, bang = (h[w.end] - h[w.start] for h in has)
    plain = length - sym - bang
    h = w.hashes()
    same = np.zeros((2, len(h)))
    for k in (1, 2):
        same[k - 1, k:] = (h[k:] == h[:-k]) & (wdoc[k:] == wdoc[:-k])
    mixed = np.sort(scramble(h + wdoc.astype(np.uint64)) >> np.uint64(20) | (wdoc.astype(np.uint64) << np.uint64(44)))  # by document, then word
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    distinct = np.bincount((mixed >> np.uint64(44)).astype(np.int64), new, n) / each
    lines = find_words(buf, off, _LINE)
    ldoc, lh, llen = lines.doc(), lines.hashes(), (lines.end - lines.start).astype(np.float64)
    lcount = np.maximum(lines.count, 1)
    lorder = np.lexsort((lh, ldoc))
    ltwin = np.zeros(len(lh))
    ltwin[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (ldoc[lorder][1:] == ldoc[lorder][:-1])
    lmean = np.bincount(ldoc, llen, n) / lcount
    lsd = np.sqrt(np.maximum(np.bincount(ldoc, llen**2, n) / lcount - lmean**2, 0))
    ends = (buf == 46) | (buf == 33) | (buf == 63)
    stops = np.bincount(doc, ends, n)
    odd = (cls == 4) | (cls == 7)
    pair = np.zeros(len(buf), bool)
    if len(buf):
        pair[1:] = odd[1:] & odd[:-1] & (doc[1:] == doc[:-1])
    run = np.bincount(doc, pair, n) / np.maximum(size, 1)
    entropy = -np.sum(share * np.log(np.maximum(share, 1e-9)), axis=1)
    cols = [np.log1p(size), np.log1p(words), mean, sd, per_word(length > 12), per_word(length < 4), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], per_word((up > 1) & (low == 0)), per_word((sym + bang > 1) & (plain > 0)), per_word(plain == 0), per_word(same[0]), per_word(same[1]), distinct, np.log1p(lines.count) - np.log1p(words), np.bincount(ldoc[lorder], ltwin, n) / lcount, np.log1p(lsd), np.log1p(words) - np.log1p(stops), run, entropy]
    out = np.stack(cols, axis=1)
    out[size == 0] = 0
    return out


_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True

# ---------------------------------------------------------------- model


@dataclass
class Model:
    """cuts: bin edges of each feature. tables: one for each feature. pairs: (a, b, coarse bins of a, of b, table)."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for a, b, ca, cb, t in self.pairs:
            out += t[ca[bins[a]], cb[bins[b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves over ordered bins: the best split first."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = None
        for n, (a, z) in enumerate(leaves):
            if z - a < 2:
                continue
            cg, ch = np.cumsum(g[a:z])[:-1], np.cumsum(h[a:z])[:-1]
            tg, th = g[a:z].sum(), h[a:z].sum()
            gain = np.where((ch >= LEAST_HESSIAN) & (th - ch >= LEAST_HESSIAN), _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th), -1)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], n, a, a + k + 1, z)
        if best is None:
            break
        leaves[best[1] : best[1] + 1] = [(best[2], best[3]), (best[3], best[4])]
    out = np.zeros(len(g))
    for a, z in leaves:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + PENALTY)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree that cuts both ways once: four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        a, b, t = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        ll = c[:-1, :-1]
        quads.append([ll, a - ll, b - ll, t - a - b + ll])
    gains = sum(_gain(x, y) for x, y in zip(*quads, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = [x[i, j] / (y[i, j] + PENALTY) for x, y in zip(*quads, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: features; y: 0 or 1."""
    if not len(y):
        return Model(0.0)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    m = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return m
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    m.cuts = [np.unique(np.concatenate([np.quantile(x[:, j], q, method="higher"), np.linspace(x[:, j].min(), x[:, j].max(), 10)[1:-1]])) for j in range(x.shape[1])]
    bins = m.bins(x)
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    f = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for b, t in zip(bins, m.tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            f += step[b]
    p = 1 / (1 + np.exp(-f))
    coarse = [(np.arange(len(t)) * PAIR_BINS // len(t)).astype(np.int64) for t in m.tables]
    cb = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cb[a] * PAIR_BINS + cb[b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    found = sorted(((_cross(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(len(bins)) for b in range(a)), reverse=True)[:PAIRS]
    tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in found]
    for _ in range(PAIR_ROUNDS):
        for (_, a, b), t in zip(found, tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _cross(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0]
            t += step
            f += step[cb[a], cb[b]]
    m.pairs = [(a, b, coarse[a], coarse[b], t) for (_, a, b), t in zip(found, tables, strict=True)]
    return m


# ---------------------------------------------------------------- DataFrame operators


def learnable() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits the model on at most so many labelled rows of those that may be learned from."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learnable()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.md5("doc_id"), "doc_id", "quality").limit(most).toPandas()  # at most `most` rows of an id and a number
    ids = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(set(chosen.doc_id)), pa.string())}))  # as Arrow: a list would go through Python workers of its own on every executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in pieces(b.column(2)):
                rows = features(buf, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.FixedSizeListArray.from_arrays(rows.reshape(-1), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "tie", "x"])

    picked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    got = picked.mapInArrow(run, "doc_id string, tie long, x array<double>").groupBy("doc_id").agg(F.min_by("x", "tie").alias("x")).toPandas()  # a row for each chosen id
    both = got.merge(chosen, on="doc_id").sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(both.x.to_list()) if len(both) else np.zeros((0, len(NAMES)))
    return fit(x, both.quality.to_numpy(np.float64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs' columns, then the score (double); a column of docs with that name is left out."""
    docs = docs.drop(name)
    bc = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bc.value.score(features(buf, off)) for _, _, buf, off in pieces(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], [*names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects (score under 0.5); docs' columns."""
    return score(docs, train(docs, labels), "__quality").where("__quality >= 0.5").drop("__quality")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
