"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Documents hang on a tree of domain, language and source. The token budget flows from the root: each node shares what it got among its children
in proportion to their weights; a child never gets more than its subtree can give (its tokens times max_epochs), and what it can't take goes to its
siblings in proportion to their weights. So a shortage is made up by siblings first; only when a whole node falls short does its parent's
other part step in. Shares are whole tokens: rounding remainders go one by one to the children in order of saturation, then name.

A leaf with budget b and t tokens gives b div t whole epochs and from the next epoch the longest prefix of at most b mod t tokens, in the order of
md5(seed:epoch:doc_id). Tokens are words between ASCII white space.

Scale: texts are read once, to count tokens; the rest moves rows of a few numbers. Leaves and bins are pre-aggregated. A leaf's prefix is found from
sums over BINS bins of the order; only the bin in which the prefix ends is sorted, so a hot leaf is spread over BINS groups and never sorted as a whole.

Defined results: null domain, language or source count as ''. Null and empty texts have 0 tokens: they come with whole epochs and inside a prefix. Rows with the
same id in the same leaf are one document with the sum of their tokens. Nodes of weight 0 or less get nothing. Where all children of a node are
exhausted, the rest of its budget stays unspent. Empty tables give empty results. Columns of docs named like this module's own don't clash: only doc_id, text, lang, source are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import materialize, table

BINS = 4096
LEAF = ["domain", "lang", "source"]


def _default_domain() -> Column:
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 4)


def _default_weights() -> tuple[Column, Column, Column]:
    domain = F.when(F.col("domain") == "domain0", 4).when(F.col("domain") == "domain1", 3).when(F.col("domain") == "domain2", 2).otherwise(1)
    lang = F.when(F.col("lang") == "en", 6).when(F.col("lang").isin("de", "fr"), 2).otherwise(1)
    return domain, lang, F.lit(1)


@dataclass
class Plan:
    """domain: from docs' columns. weights: whole numbers for a node from domain, lang, source (of its level and above). share: of all tokens, in thousandths, to spend."""

    domain: Column = field(default_factory=_default_domain)
    weights: tuple[Column, Column, Column] = field(default_factory=_default_weights)
    share: int = 600
    max_epochs: int = 2
    seed: int = 17


def n_words(text: str = "text") -> Column:
    """Words between ASCII white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.size(F.split(t, "[\\x20\\x09-\\x0D]+", -1))
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    blank = "^[\\x20\\x09-\\x0D]$"
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(0), parts - first.rlike(blank).cast("int") - last.rlike(blank).cast("int"))).cast("long")


def _share_out(nodes: DataFrame, above: list[str], name: str) -> DataFrame:
    """nodes (above, name, weight, cap, budget of the node above) with their own share as budget."""
    nodes = nodes.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight").cast("long")).otherwise(F.lit(0)))
    group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    d = lambda c: F.col(c).cast("decimal(38,0)")
    n = (
        nodes.withColumn("all_w", F.sum("weight").over(group))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("c_before", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(zero)).over(before), zero))
        .withColumn("full", (F.col("weight") > 0) & (d("cap") * (d("all_w") - d("w_before")) <= (d("budget") - d("c_before")) * d("weight")))
        .withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), zero))
        .withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(group), zero))
        .withColumn("num", d("budget") - d("c_full"))
        .withColumn("den", F.greatest(d("all_w") - d("w_full"), F.lit(1).cast("decimal(38,0)")))
        .withColumn("part", F.when(F.col("full"), F.col("cap")).when(F.col("weight") > 0, F.expr("cast((num * cast(weight as decimal(38,0))) div den as bigint)")).otherwise(zero))
    )
    open_ = ~F.col("full") & (F.col("weight") > 0)
    n = n.withColumn("rest", F.when(F.max(open_).over(group), F.col("budget") - F.sum("part").over(group)).otherwise(zero)).withColumn("turn", F.sum(open_.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return n.withColumn("budget", F.col("part") + (open_ & (F.col("turn") <= F.col("rest"))).cast("long")).select(*nodes.columns)


def leaf_budgets(counted: DataFrame, plan: Plan) -> DataFrame:
    """domain, lang, source, have, budget for each leaf of counted (LEAF, n_tokens)."""
    leaves = materialize(counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("have")).withColumn("cap", F.col("have") * plan.max_epochs), "leaves")
    whole = F.expr(f"cast((cast(have as decimal(38,0)) * {int(plan.share)}) div 1000 as bigint)")
    up = None
    for level in range(3):
        keys = LEAF[: level + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("have").alias("have"))
        if up is None:
            nodes = nodes.withColumn("have", F.sum("have").over(Window.partitionBy(F.lit(0)))).withColumn("budget", whole)  # a row for each domain
        else:
            nodes = nodes.join(up, LEAF[:level])
        up = _share_out(nodes.withColumn("weight", plan.weights[level]), LEAF[:level], keys[-1]).select(*keys, "budget")
    return leaves.join(up, LEAF).select(*LEAF, "have", "budget")


def select(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: one row for each document and epoch that gives it."""
    plan = plan or Plan()
    named = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(plan.domain, F.lit("")).alias("domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEAF[1:]))
    light = named.select("doc_id", *LEAF, n_words().alias("n_tokens"))
    counted = materialize(light.groupBy("doc_id", *LEAF).agg(F.sum("n_tokens").alias("n_tokens")), "counted")
    leaves = materialize(
        leaf_budgets(counted, plan).select(*LEAF, F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(F.lit(0)).alias("whole"), F.when(F.col("have") > 0, F.col("budget") % F.col("have")).otherwise(F.lit(0)).cast("long").alias("rest")), "budgets"
    )
    known = counted.join(leaves, LEAF)
    whole = known.where("whole > 0").select("doc_id", *LEAF, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    key = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = known.where("rest > 0").withColumn("key", key).withColumn("bin", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BINS)
    bins = part.groupBy(*LEAF, "bin").agg(F.sum("n_tokens").alias("n"))
    begun = bins.select(*LEAF, "bin", "n", (F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bin")) - F.col("n")).alias("begin"))
    placed = part.join(materialize(begun, "bins"), [*LEAF, "bin"])
    inside = placed.where("begin + n <= rest and begin < rest")
    edge = placed.where("begin + n > rest and begin < rest")
    end = F.col("begin") + F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("end", end).where("end <= rest and end - n_tokens < rest")
    cols = ["doc_id", *LEAF, "n_tokens", F.col("whole").alias("epoch")]
    return whole.unionByName(inside.select(*cols)).unionByName(edge.select(*cols))


def mix(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """docs' rows, each as many times as it is selected; docs' columns."""
    plan = plan or Plan()
    copies = select(docs, plan).groupBy("doc_id", *LEAF).agg(F.count("*").alias("__copies")).toDF("__id", "__domain", "__lang", "__source", "__copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.coalesce(plan.domain, F.lit("")) == F.col("__domain")) & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__lang")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("__source"))
    return docs.join(copies, same).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"))


def _level(name: str, source: str, keys: list[str], weight: str) -> str:
    above = ", ".join(keys[:-1])
    part = f"PARTITION BY {above}" if above else ""
    k, sel = keys[-1], ", ".join(keys)
    order = f"({part} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'infinity'::DOUBLE END, {k}"
    join = f"JOIN {source} p USING ({above})" if above else f"CROSS JOIN {source} p"
    return f"""{name}0 AS (
  SELECT {sel}, cap, budget, {weight} AS w FROM (SELECT {sel}, sum(have * 2) AS cap FROM leaves GROUP BY {sel}) {join}
), {name}1 AS (
  SELECT *, sum(w) OVER ({part}) AS aw, coalesce(sum(w) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
         coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM {name}0
), {name}2 AS (
  SELECT *, cap * (aw - wb) <= (budget - cb) * w AS f FROM {name}1
), {name}3 AS (
  SELECT *, coalesce(sum(CASE WHEN f THEN cap END) OVER ({part}), 0) AS cf, coalesce(sum(CASE WHEN f THEN w END) OVER ({part}), 0) AS wf FROM {name}2
), {name}4 AS (
  SELECT *, CASE WHEN f THEN cap ELSE ((budget - cf) * w) // greatest(aw - wf, 1) END AS part FROM {name}3
), {name}5 AS (
  SELECT *, CASE WHEN bool_or(NOT f) OVER ({part}) THEN budget - sum(part) OVER ({part}) ELSE 0 END AS rest,
         sum((NOT f)::INT) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM {name}4
), {name} AS (
  SELECT {sel}, part + (CASE WHEN NOT f AND turn <= rest THEN 1 ELSE 0 END) AS budget FROM {name}5
)"""


ORACLE = (
    r"""
WITH counted AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '(\d{1,9})$', 1) AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n_tokens
  FROM documents GROUP BY ALL
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS have FROM counted GROUP BY ALL
), root AS (
  SELECT (sum(have) * 600) // 1000 AS budget FROM leaves
), """
    + _level("a", "root", ["domain"], "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END")
    + ", "
    + _level("b", "a", ["domain", "lang"], "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")
    + ", "
    + _level("c", "b", ["domain", "lang", "source"], "1")
    + r""", budgets AS (
  SELECT domain, lang, source, CASE WHEN have > 0 THEN budget // have ELSE 0 END AS whole, CASE WHEN have > 0 THEN budget % have ELSE 0 END AS rest
  FROM leaves JOIN c USING (domain, lang, source)
), known AS (
  SELECT * FROM counted JOIN budgets USING (domain, lang, source)
), ranked AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS fin FROM known WHERE rest > 0
)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(unnest(range(0, CAST(whole AS BIGINT))) AS BIGINT) AS epoch FROM known
UNION ALL
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT), CAST(whole AS BIGINT) FROM ranked WHERE fin <= rest AND fin - n_tokens < rest
"""
)
