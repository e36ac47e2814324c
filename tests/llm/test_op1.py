import itertools
import random

import numpy as np
from helpers import SF, docs, oracle, same

from pagewright.llm import op1_decontaminate as o


def words(r, n):
    return ["w" + str(r.randrange(10**6)) for _ in range(n)]


def brute(texts, items):
    """Pairs of a document and item with an alignment that counts."""
    import re

    toks = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    want = set()
    for (i, w), (k, t) in itertools.product(enumerate(toks), enumerate(items)):
        v = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        if len(v) < o.SHORTEST:
            continue
        width = min(o.WINDOW, len(v))
        need = o.NEED if len(v) >= o.WINDOW else len(v)
        for shift in range(-len(v), len(w)):
            eq = [0 <= j + shift < len(w) and w[j + shift] == v[j] for j in range(len(v))]
            if any(sum(eq[a : a + width]) >= need for a in range(len(v) - width + 1)):
                want.add((i, k))
                break
    return want


def test_masks_hit_every_window_with_two_substitutions():
    for pair in itertools.combinations(range(o.WINDOW), 2):
        assert any(all(a + j not in pair for j, c in enumerate(m) if c == "1") for m in o.LONG_MASKS for a in range(o.WINDOW - len(m) + 1))


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [" ".join(words(r, n)) for n in (13, 20, 40, 14, 5, 8, 4, 1)] + [None, "", " ".join(words(r, 30)).upper()]
    texts = []
    for k in range(120):
        t = words(r, r.randrange(0, 60))
        it = (items[r.randrange(len(items))] or "").split()
        a = r.randrange(len(it) + 1)
        it = it[a : a + r.randrange(8, 41)]
        for _ in range(r.randrange(0, 5)):
            if it:
                it[r.randrange(len(it))] = "sub"
        at = r.randrange(len(t) + 1)
        texts.append(" ".join(t[:at] + [x + r.choice(["", ",", "***", ".\n"]) for x in it] + t[at:]))
    texts += [None, "", "x"]
    want = brute(texts, items)
    assert 10 < len(want) < 120
    d = docs(spark, list(enumerate(texts)))
    for block in (o.BLOCK_BYTES, 300):  # one block; many
        got = {(x.doc_id, x.item_id) for x in o.matches(d, bench(spark, items), block).collect()}
        assert got == want
        left = o.decontaminate(d, bench(spark, items), block)
        assert left.columns == d.columns
        assert sorted(x.doc_id for x in left.collect()) == sorted(set(range(len(texts))) - {a for a, _ in want})
    tables = {"documents": ("doc_id BIGINT, text VARCHAR", list(enumerate(texts))), "benchmark": ("item_id BIGINT, text VARCHAR", list(enumerate(items)))}
    same(o.matches(d, bench(spark, items)), oracle(o.ORACLE, tables))


def test_oracle(spark):
    same(o.op1_decontaminate(spark, SF), oracle(o.ORACLE))


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    d = docs(spark, [(1, item), (1, item), (None, "x " + item + " y"), (2, None), (3, "É " + "long " * 300_000 + item.replace("iota", "other"))])
    b = spark.createDataFrame([(7, item, "x"), (7, item, "y"), (None, "ÉTÉ " * 20, "z"), (8, None, "z")], "item_id long, text string, doc_id string")
    got = sorted(((x.doc_id, x.item_id, x.doc_start, x.item_start, x.n_tokens, x.n_equal) for x in o.matches(d.withColumnRenamed("lang", "item_id"), b).collect()), key=repr)
    assert got == sorted([(1, 7, 0, 0, 15, 15), (1, 7, 0, 0, 15, 15), (None, 7, 1, 0, 15, 15), (3, 7, 300_001, 0, 15, 14)], key=repr)
    assert [x.doc_id for x in o.decontaminate(d, b).collect()] == [2]
    for empty_d, empty_b in ((d.limit(0), b), (d, b.limit(0))):
        assert o.matches(empty_d, empty_b).count() == 0
    assert o.decontaminate(d, b.limit(0)).count() == 5
    assert o.matches(docs(spark, [(1, "été " * 20)]), b).count() == 1  # Latin-1 capitals are folded


def test_first_of_equal_alignments():
    b = o.Block.build([1], ["a b c d e f"])
    t = b"a b c d e f - a b c d e f"
    got = b.find(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    assert got.doc_start.tolist() == [0]


def test_repetitive_texts(monkeypatch):
    """Every alignment is compared once, part by part: the same rows as with all at once, in bounded time."""
    import time

    import numpy as np

    def find(items, texts):
        raw = [t.encode() for t in texts]
        return o.Block.build(list(range(len(items))), items).find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    items = ["a " * 100, "a " * 60 + "b " + "a " * 60, "a b " * 40, "x y z " * 20, "c " * 13]
    texts = ["a " * 700, "a b " * 300, "a " * 70 + "b " + "a " * 70, "y z x " * 90, "q " * 50 + "c " * 30]
    want = {}
    for i, item in enumerate(items):
        for d, text in enumerate(texts):
            w, t = item.split(), text.split()
            for shift in range(-len(w), len(t)):
                eq = [0 <= shift + k < len(t) and t[shift + k] == x for k, x in enumerate(w)]
                good = [k for k in range(len(w) - 12) if sum(eq[k : k + 13]) >= 11]
                if good:
                    row = (-sum(eq[good[0] : good[-1] + 13]), shift + good[0], good[0], good[-1] + 13 - good[0])
                    want[d, i] = min(want.get((d, i), row), row)
    for part in (1 << 20, 300):
        monkeypatch.setattr(o, "PART", part)
        got = find(items, texts)
        assert {(r.doc, r.item): (-r.n_equal, r.doc_start, r.item_start, r.n_tokens) for r in got.itertuples()} == want
    monkeypatch.setattr(o, "PART", 1 << 20)
    began = time.process_time()
    got = find(["a " * 200, "a " * 199 + "b "], ["a " * 50_000])
    assert time.process_time() - began < 20
    assert got.n_equal.tolist() == [200, 199]
