from pagewright.operators.replacer import Fifo, replacer_events


def replay(ops):
    f = Fifo()
    return f, [f.apply(o, a) for o, a in ops]


def loaded(*frames):
    return [x for i in frames for x in (("access", i), ("evictable", i))]


def evicted(ops, n):
    f, _ = replay(ops)
    return [f.apply("evict", None) for _ in range(n)], f


def test_order():
    assert evicted(loaded(0, 1, 2), 4)[0] == [0, 1, 2, None]


def test_only_evictable_ones_go():
    assert evicted([("access", 0), ("access", 1), ("access", 2), ("evictable", 1)], 2)[0] == [1, None]


def test_remove():
    assert evicted([*loaded(0, 1), ("remove", 0), ("remove", 9)], 2)[0] == [1, None]


def test_another_access_keeps_the_place():
    assert evicted([*loaded(0, 1), ("access", 0)], 2)[0] == [0, 1]


def test_failed_evictions_keep_the_queue():
    f, got = replay([("access", 0), ("access", 1), ("evict", None), ("evict", None), ("evictable", 1), ("evictable", 0), ("size", None), ("evict", None), ("evict", None)])
    assert got[2:4] == [None, None]
    assert got[6:] == [2, 0, 1]


def test_pinned_again_and_unknown_frames():
    f, got = replay([("evictable", 5), ("size", None), ("evict", None), *loaded(0, 1), ("pinned", 0), ("evict", None), ("size", None), ("what", 3), ("access", None)])
    assert got[1:3] == [1, None]
    assert got[-4:-2] == [1, 1]


def test_spark_equals_the_class(spark):
    rows = [(t, i, ["access", "evictable", "pinned", "evict", "remove", "size"][(i * 7 + k) % 6], (i * 5 + k) % 4) for k, t in enumerate(("a", None)) for i in range(80)]
    df = spark.createDataFrame(rows[::-1], "trace_id string, seq long, op string, frame_id long")
    got = {(r.trace_id, r.seq): r.value for r in replacer_events(df).collect()}
    want = {}
    for t in ("a", None):
        mine = [r for r in rows if r[0] == t]
        want |= {(t, r[1]): v for r, v in zip(mine, replay([(r[2], r[3]) for r in mine])[1], strict=True)}
    assert got == want
    assert replacer_events(df.limit(0)).count() == 0
