import random

from helpers import SF, docs, oracle, same
from pyspark.sql import functions as F

from pagewright.llm import op9_mix as o


def test_oracle(spark):
    same(o.op9_mix(spark, SF), oracle(o.ORACLE))


def rows_of(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["en", "en", "de", "fr", None]), r.choice(["src0"] * 6 + ["src1", "src2", "src5", "src10", None, "odd"])) for i in range(n)]


def test_oracle_on_a_skewed_table(spark):
    rows = rows_of(4, 700)
    same(o.select(docs(spark, rows)), oracle(o.ORACLE, {"documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows)}))


def test_shortage_goes_to_siblings_first(spark):
    cap = {("a", "en", "x"): 100, ("a", "en", "y"): 10, ("a", "de", "z"): 100, ("b", "en", "w"): 20}
    counted = spark.createDataFrame([(*k, v) for k, v in cap.items()], "domain string, lang string, source string, n_tokens long")
    one = F.lit(1)
    plan = o.Plan(weights=(one, one, one), share=500, max_epochs=1)  # 115 of 230
    got = {tuple(r)[:3]: r.budget for r in o.leaf_budgets(counted, plan).collect()}
    # b can give 20, so a gets 95: 48 and 47; y can give 10, so x makes up for it, not z.
    assert got == {("b", "en", "w"): 20, ("a", "de", "z"): 48, ("a", "en", "x"): 37, ("a", "en", "y"): 10}


def test_prefix_is_whole_over_bins(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "src0") for i in range(3000)]
    got = o.select(docs(spark, rows), o.Plan(share=330)).collect()
    total = sum(1 + i % 7 for i in range(3000))
    spent = sum(r.n_tokens for r in got)
    assert total * 330 // 1000 - 7 <= spent <= total * 330 // 1000
    assert {r.epoch for r in got} == {0}
    other = o.select(docs(spark, rows), o.Plan(share=330, seed=18)).collect()
    assert {r.doc_id for r in got} != {r.doc_id for r in other}


def test_epochs(spark):
    rows = [(i, "w w w", "en", "src0") for i in range(50)] + [(100, "w " * 30, "en", "src1")]
    plan = o.Plan(weights=(F.when(F.col("domain") == "domain1", 9).otherwise(1), F.lit(1), F.lit(1)), share=1000, max_epochs=3)
    got = o.select(docs(spark, rows), plan)
    assert sorted(r.epoch for r in got.where("doc_id = 100").collect()) == [0, 1, 2]
    mixed = o.mix(docs(spark, rows), plan)
    assert mixed.columns == docs(spark, rows).columns
    assert mixed.where("doc_id = 100").count() == 3
    assert mixed.count() == got.count()


def test_edges(spark):
    rows = [(1, None, None, None), (None, "a b", "en", "src1"), (2, "", "en", "src1"), (3, "a b c", "en", "src1"), (3, "a b c", "en", "src1"), (3, "x " * 5, "de", "src1"), (4, "long " * 100_000, "xx", "")]
    d = docs(spark, rows).selectExpr("*", "1 AS domain", "2 AS budget", "3 AS epoch", "'q' AS key")
    got = o.select(d, o.Plan(share=1000, max_epochs=1))
    assert {(r.doc_id, r.lang, r.n_tokens) for r in got.collect()} >= {(None, "en", 2), (3, "en", 6), (3, "de", 5), (4, "xx", 100_000)}
    assert o.mix(d, o.Plan(share=1000, max_epochs=1)).where("doc_id = 3").count() == 3
    assert o.select(d.limit(0)).count() == 0
    assert o.mix(d.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = o.op9_mix(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Pandas" not in plan
    assert "CartesianProduct" not in plan
