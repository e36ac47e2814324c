import hashlib
import random
import re

import pytest
from helpers import SF, docs, oracle, same
from pyspark.sql import functions as F

from pagewright.llm import op6_repeats as o
from pagewright.session import table


def brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_oracle(spark):
    same(o.op6_repeats(spark, SF), oracle(o.ORACLE))


@pytest.mark.parametrize(("seed", "alphabet"), [(1, 3), (2, 30), (3, 5000)])
def test_against_brute_force(spark, seed, alphabet):
    r = random.Random(seed)
    rows = []
    for i in range(80):
        w = [f"w{r.randrange(alphabet)}" for _ in range(r.randrange(0, 90))]
        if rows and r.random() < 0.7:
            other = (rows[r.randrange(len(rows))][1] or "").split()
            a = r.randrange(len(other) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = other[a : a + r.randrange(10, 60)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    rows += [(200, "same " * 100), (201, "same " * 100), (202, None), (203, ""), (204, "a b " * 40), (205, " \t ")]
    assert rows_of(o.remove_repeats(docs(spark, rows))) == brute(rows, 20)
    assert rows_of(o.remove_repeats(docs(spark, rows), window=9, anchor=4)) == brute(rows, 9)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(30))
    d = docs(spark, [(1, t), (1, t), (None, t), (2, "y " + t), (2, None)]).selectExpr("*", "1 AS hits", "2 AS n_words")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in o.remove_repeats(d).collect()), key=repr)
    assert got == sorted([(None, 30, 0), (1, 30, 30), (1, 30, 30), (2, 31, 30), (2, 0, 0)], key=repr)


def test_long_and_empty(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    got = rows_of(o.remove_repeats(docs(spark, [(2, long), (1, " ".join(f"v{i}" for i in range(1000)))])))
    assert (got[1][1], got[2][:2]) == (0, (200_000, 1000))
    assert o.remove_repeats(docs(spark, [(1, "x")]).limit(0)).count() == 0
    assert table(spark, SF, "documents").count() > 0


def test_paths_are_compacted(spark):
    """A passage between unique words is one path; where continuations differ, paths end; occurrences are equal and whole."""
    r = random.Random(2)

    def own(n):
        return [f"u{r.randrange(10**9)}" for _ in range(n)]

    p, q, s = [f"p{i}" for i in range(300)], [f"q{i}" for i in range(80)], [f"s{i}" for i in range(80)]
    texts = [own(30) + p + own(30), own(7) + p + own(50), p + q, own(3) + p + q + own(5), p + s, own(9) + s]
    d = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    parts = o.pieces_of(d).selectExpr("key AS p1", "content AS p2", "doc_id", "start", "n")
    many = parts.groupBy("p1", "p2").count().where("count > 1").drop("count")
    found = o.compacted(parts.join(many, ["p1", "p2"])).collect()
    of_p = [x for x in found if x.doc_id in (0, 1) and x.n > 13]
    assert len(of_p) == 2  # the 281 edges of p, but for pieces that reach into what stands around it
    assert len({(x.h1, x.h2, x.n, x.chain, x.n_pieces) for x in of_p}) == 1
    assert of_p[0].n_pieces > 15 and of_p[0].n > 250
    assert all(x.n_pieces == 1 for x in found if x.doc_id in (0, 1) and x.n <= 13)
    first = {(x.h1, x.h2): x for x in found}
    assert len({(x.doc_id, x.start) for x in found}) == len(found)
    for x in found:
        assert (x.n, x.chain) == (first[x.h1, x.h2].n, first[x.h1, x.h2].chain)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert rows_of(o.remove_repeats(d)) == brute(rows, 20)


def test_equal_pieces_at_branches_are_cut_once(spark, monkeypatch):
    """Of near copies only first occurrences of a piece are cut into edges; the graph doesn't grow with their number."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(8) * 50 + 20] = f"z{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    rows += [(300, rows[7][1] + " tail " + rows[7][1]), (301, " ".join(base[5:60] + base[30:90]))]
    real, given = o.compacted, []

    def spy(parts, *a, **k):
        given.append(parts.count())
        return real(parts, *a, **k)

    monkeypatch.setattr(o, "compacted", spy)
    assert rows_of(o.remove_repeats(docs(spark, rows))) == brute(rows, 20)
    branching = o.pieces_of(docs(spark, rows)).groupBy("key").agg(F.countDistinct("content").alias("kinds"), F.count("*").alias("times"), F.max("loop").alias("loop"))
    plain = branching.where("kinds = 1 and times > 1 and not loop").agg(F.sum("times")).first()[0] or 0
    assert given[0] - plain < 120 * 381 / 10
