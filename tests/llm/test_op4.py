import zlib

import numpy as np
from helpers import docs

from pagewright.llm import op4_quality as o
from pagewright.session import table

SF = "/root/testdata/sf0.01"


def auc(s, y):
    p, q = s[y == 1], s[y == 0]
    return np.mean((p[:, None] > q[None]) + 0.5 * (p[:, None] == q[None]))


def test_held_out(spark):
    got = o.op4_quality(spark, SF).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert len(test) > 80
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.97
    assert (test.predicted == test.quality).mean() > 0.95


def test_model_learns_pairs():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = o.fit(x[:3000], y[:3000])
    assert auc(m.score(x[3000:]), y[3000:]) > 0.9
    by_hand = m.base + sum(t[np.searchsorted(c, x[0, j], "right")] for j, (c, t) in enumerate(zip(m.cuts, m.tables, strict=True)))
    by_hand += sum(t[ca[np.searchsorted(m.cuts[a], x[0, a], "right")], cb[np.searchsorted(m.cuts[b], x[0, b], "right")]] for a, b, ca, cb, t in m.pairs)
    assert abs(m.margin(x[:1])[0] - by_hand) < 1e-9


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"One two two. Three!\nfour", "é".encode() * 50, b"*** $$$ a### b", b" "]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = o.features(buf, off)
    for i, t in enumerate(texts):
        one = o.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert np.allclose(whole[i], one)
    assert not whole[0].any()


def test_edges(spark):
    d = docs(spark, [(i, t) for i in range(40) for t in ("good text, it reads well.", "BAD!! BAD!!")] + [(None, None), (99, ""), (98, "long " * 200_000)]).selectExpr("*", "1 AS score", "2 AS held_out")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 0, 0), (None, 1, 0), (3, None, 1), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    assert o.quality_rows(d, labels).count() == d.count()
    kept = o.keep_good(d, labels)
    assert kept.columns == d.columns
    for no in (labels.limit(0), labels.where("quality = 1")):
        got = o.quality_rows(d, no).toPandas()
        assert got.score.nunique() == 1
        assert (got.predicted == 1).all()
    assert o.quality_rows(d.limit(0), labels).count() == 0


def test_against_brute_force(spark):
    """Ids of text, repeated ids with other texts: the same model and scores as from plain loops, in any order of rows."""
    t = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    y = table(spark, SF, "labels").toPandas()
    d = [(f"d{i}", x) for i, x in zip(t.doc_id, t.text)] + [(f"d{i}", "other text, the same id") for i in t.doc_id[:50]]
    lab = [(f"d{i}", int(q), 0) for i, q in zip(y.doc_id, y.quality)]
    frame, labels = spark.createDataFrame(d, "doc_id string, text string"), spark.createDataFrame(lab, "doc_id string, quality int, toxic int")
    tie = {(r.doc_id, r.text): r.h for r in frame.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    use = {}
    for i, x in sorted(d, key=lambda r: -tie[r]):
        use[i] = x

    def row(text):
        b = np.frombuffer((text or "").encode(), np.uint8)
        return o.features(b, np.array([0, len(b)]))[0]

    learn = sorted((i, q) for i, q, _ in lab if zlib.crc32(i.encode()) % 3 != 1 and i in use)
    m = o.fit(np.stack([row(use[i]) for i, _ in learn]), np.array([q for _, q in learn], float))
    want = sorted((i, round(float(m.score(row(x)[None])[0]), 9)) for i, x in d)
    for n in (1, 5):
        got = o.quality_rows(frame.repartition(n), labels.repartition(n)).collect()
        assert sorted((r.doc_id, round(r.score, 9)) for r in got) == want
        assert all(r.held_out == (zlib.crc32(r.doc_id.encode()) % 3 == 1) for r in got)


def test_training_ids_need_no_python_workers(spark, monkeypatch):
    """A list given to createDataFrame is parallelized as pickled rows, for Python workers beside those of the operators."""

    def refuse(*_):
        raise AssertionError("rows went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert len(o.train(table(spark, SF, "documents"), table(spark, SF, "labels"), 200).tables) == len(o.NAMES)
