import corpus_pipeline as cp
import pytest
from helpers import SF, docs

import __spark_entry__
from pagewright.llm import op1_decontaminate, op2_minhash
from pagewright.session import materialize, table


def test_stages_in_order(spark):
    d = table(spark, SF, "documents")
    cols, counts = d.columns, []
    for name, stage in cp.STAGES[:-1]:
        d = materialize(stage(spark, d, SF), f"test-{name}")
        assert d.columns == cols
        counts.append(d.count())
        if name == "near_dedup":
            assert op2_minhash.near_classes(d).where("not kept").count() == 0
        if name == "decontaminate":
            assert op1_decontaminate.matches(d, table(spark, SF, "benchmark")).count() == 0
    assert counts[0] >= counts[1] >= counts[2] > 0
    out = cp.STAGES[-1][1](spark, d, SF)
    assert out.count() == counts[-1]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, cp.run(spark, SF).collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, k):
    stage = cp.STAGES[k][1]
    d = docs(spark, [(None, None), (1, "x y z " * 20, "en", "src1"), (1, "x y z " * 20, "en", "src1"), (2, "", None, None), (3, "word " * 5000, "de", "src2")])
    stage(spark, d, SF).collect()
    assert stage(spark, d.limit(0), SF).count() == 0


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q
    for n in range(1, 11):
        assert len([k for k in q if k.startswith(f"op{n}_")]) == 1


def test_against_brute_force(spark):
    """Every stage by plain loops or SQL over what the one before it kept."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    from helpers import oracle
    from test_op2 import brute
    from tokenizers import Tokenizer

    from pagewright.llm import op1_decontaminate as o1
    from pagewright.llm import op4_quality as o4
    from pagewright.llm import op9_mix as o9

    sf = "/root/testdata/sf0.001"
    schema = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"
    docs_ = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]

    def features(text):
        b = np.frombuffer((text or "").encode(), np.uint8)
        return o4.features(b, np.array([0, len(b)]))[0]

    text = {r[0]: r[1] for r in docs_}
    learn = sorted((str(r.doc_id), r.quality, r.doc_id) for r in table(spark, sf, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in text)
    model = o4.fit(np.stack([features(text[i]) for _, _, i in learn]), np.array([q for _, q, _ in learn], float))
    docs_ = [r for r in docs_ if model.score(features(r[1])[None])[0] >= 0.5]
    group = brute([(r[0], r[1]) for r in docs_], 5)
    docs_ = [r for r in docs_ if group[r[0]] == r[0]]
    names, hit = oracle(o1.ORACLE, {"documents": (schema, docs_)})
    bad = {r[names.index("doc_id")] for r in hit}
    docs_ = [r for r in docs_ if r[0] not in bad]
    names, mixed = oracle(o9.ORACLE, {"documents": (schema, docs_)})
    tok, by_id, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {r[0]: r for r in docs_}, 0, []
    for i in sorted(r[names.index("doc_id")] for r in mixed):
        ids = np.array([*tok.encode(by_id[i][1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in cp.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert len(want) > 20
    assert got == want
