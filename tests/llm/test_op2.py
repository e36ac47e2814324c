import random
import re

import numpy as np
from helpers import SF, docs, oracle, same

from pagewright.llm import op2_minhash as o
from pagewright.llm.graph import components

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows, width, percent=80):
    """component of each row's id, by all pairs."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        root(i)
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in rows if i is not None}


def check(spark, rows, width):
    got = o.near_classes(docs(spark, rows), width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t, width))) for i, t in rows if i is not None)
    return got


def variants(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(most + 1)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_of_all_degrees(spark):
    r = random.Random(2)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(20, 160))]
        texts += variants(r, base, 25, 12)
    texts += ["", None, "One", "one", "ONE two", "a a a a", "a a", "Ünïcode", "ünïcode", " \t\n"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    for width in (2, 5):
        check(spark, rows, width)


def test_large_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(80)]
    check(spark, list(enumerate(variants(r, base, 150, 8))), 2)


def test_repeated_null_and_long(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (3, "a b c d e f"), (9, "p q r s t u"), (9, "p q r s t u"), (None, "a b c d e f"), (None, None), (1, long), (2, long + " end"), (4, None), (6, "")]
    got = check(spark, rows, 2)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    d = docs(spark, [(*x, "en", f"s{n}") for n, x in enumerate(rows)])
    left = o.deduplicate(d, 2)
    assert left.columns == d.columns
    assert sorted((x.doc_id for x in left.collect()), key=repr) == sorted([None, None, 1, 3, 4, 6], key=repr)


def test_deduplicate_repeated_and_null_ids(spark):
    """Of an id's rows one stays, the same in any order of tasks; rows without an id all stay; a single id's row is untouched."""
    rows = [(7, f"text {i} of the hot id " + " ".join(f"w{i}x{j}" for j in range(9))) for i in range(200)] + [(7, None), (8, ""), (8, "")] + [(None, f"no id {i}") for i in range(150)] + [(9, "one row of its own")]
    d = docs(spark, [(*x, "en", "s") for x in rows]).withColumnRenamed("n_chars", "__rows")
    got = [sorted(map(tuple, o.deduplicate(x).collect()), key=repr) for x in (d.repartition(7), d.coalesce(1))]
    assert got[0] == got[1]
    assert [sum(r[0] == k for r in got[0]) for k in (7, 8, 9, None)] == [1, 1, 1, 150]


def test_empty(spark):
    d = docs(spark, [(1, "x")]).limit(0)
    assert o.near_classes(d).count() == 0
    assert o.deduplicate(d).count() == 0


def test_oracle(spark):
    same(o.op2_minhash(spark, SF), oracle(o.ORACLE))


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    agree = np.mean([np.mean(o.signature(a ^ np.uint64(k)) == o.signature(b ^ np.uint64(k))) for k in range(8)])
    assert abs(agree - 1 / 3) < 0.06
    assert (o.signature(a) == o.signature(a[::-1])).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (3, None), (1, 0), (1, 0)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    """Small limits: near copies over many blocks, chains whose ends differ, and wide buckets, against brute force."""
    monkeypatch.setattr(o, "BLOCK", 5)
    monkeypatch.setattr(o, "SMALL", 3)
    monkeypatch.setattr(o, "WIDE", 6)
    r = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [t for t in variants(r, base, 25, 4)]
    w = [f"c{i}" for i in range(60)]
    for i in range(0, 120, 2):  # each like the one before, not like the first
        w[i % 60] = f"n{i}"
        rows.append(" ".join(w))
    r.shuffle(rows)
    check(spark, list(enumerate(rows)), 2)


def test_recall_near_the_limit():
    """Share of pairs of similarity 0.80 to 0.82 that meet in a band and that the bits let pass; also short sets."""
    r = np.random.default_rng(3)
    met = passed = n = 0
    for size in (9, 18, 45, 90, 450):
        for _ in range(400):
            both = r.integers(0, 2**63, size * 80 // 90 + size, dtype=np.int64).astype(np.uint64)
            same = (4 * size + 4) // 5
            rest = size - same
            a, b = np.unique(np.append(both[:same], both[same : same + rest // 2])), np.unique(np.append(both[:same], both[same + rest // 2 : same + rest]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if not 0.8 <= j <= 0.83:
                continue
            x, y = o._describe(a), o._describe(b)
            n += 1
            met += bool(np.any(x[5] == y[5]))
            passed += sum((p ^ q).bit_count() for p, q in ((x[3] & 2**64 - 1, y[3] & 2**64 - 1), (x[4] & 2**64 - 1, y[4] & 2**64 - 1))) <= o.MOST_BITS
    print(f"recall of {n} pairs: bands {met / n:.4f}, bits {passed / n:.4f}")
    assert n > 1000
    assert met / n > 0.999
    assert passed / n > 0.999
