"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source.  A node's token budget is split among
its children by their weights; a child that cannot use its part (its documents
times ``EPOCHS``) is filled, and what it leaves goes to its siblings by weight,
and only what all siblings together cannot use is left to the level above.  A
leaf takes whole epochs first and then the token-prefix of the next epoch's
seeded order: the documents whose running total stays within the budget.

All arithmetic is in whole tokens.  A hot leaf is never sorted in one task:
running totals go over 4096 slices of the seeded order first, and only the
slice in which the budget ends is ordered document by document.

Null language or source is a leaf of its own (empty name); null texts have 0
tokens.  Repeated rows are separate documents with the same place in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spate.llm.common import stage

SEED = 17
EPOCHS = 2
#: Budget as a share of the corpus tokens: 1 / 2.
BUDGET_NUM, BUDGET_DEN = 1, 2
#: Domains by the last digit of the source's name, and target weights of each level (others: 1).
DOMAINS = {"web": "0123", "books": "456", "code": "789"}
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2}
SOURCE_WEIGHTS = {"src0": 2}
#: Hexadecimal digits of the order that name a slice.
SLICE_HEX = 3
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    last = F.substring(source, -1, 1)
    out = F.lit("other")
    for name, digits in DOMAINS.items():
        out = F.when((source != "") & last.isin(*digits), name).otherwise(out)
    return out


def token_rows(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """Narrow rows (doc_id, domain, lang, source, n_tokens); tokens are words [^\\x20\\x09-\\x0D]+."""
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), domain_of(src).alias("domain"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), src.alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent among its children (columns cap, weight): column ``budget`` of the child.

    Children in the order of cap / weight fill up first; the rest divide what
    is left by weight.  A window over the children of one node: leaves are
    aggregated names, not documents.
    """
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name) if parents else Window.orderBy(F.col("cap") / F.col("weight"), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = children.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    x = x.withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * (F.col("parent_budget") - F.col("used")))
    x = x.withColumn("filled", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).withColumn(
        "left_w", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    )
    part = F.expr("(weight * (parent_budget - filled)) div left_w")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("used", "open", "full", "filled", "left_w", "parent_budget")


def plan(rows: DataFrame, budget: int, epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """Per leaf: tokens of an epoch, whole epochs, and tokens of the last, partial one."""
    leaf = stage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mixing-leaves")
    leaf = leaf.withColumn("cap", F.col("tokens") * F.lit(epochs))
    above = None
    for k, level in enumerate(LEVELS):
        node = leaf.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        node = node.withColumn("weight", _weight(level, weights[k]))
        if above is None:
            node = node.withColumn("parent_budget", F.least(F.lit(budget).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(1)))))
        else:
            node = node.join(above, list(LEVELS[:k]))
        node = share(node, list(LEVELS[:k]), level)
        above = node.select(*LEVELS[: k + 1], F.col("budget").alias("parent_budget"))
    epochs_of = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    out = node.select(*LEVELS, "tokens", "budget", epochs_of.alias("full_epochs"))
    return out.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    seed: int = SEED,
    epochs: int = EPOCHS,
    weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
) -> DataFrame:
    """The selected rows: doc_id, domain, lang, source, n_tokens, epoch (0, 1, ...)."""
    rows = stage(token_rows(docs, doc_id, text, lang, source), "mixing-rows")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = stage(plan(rows, total * BUDGET_NUM // BUDGET_DEN, epochs, weights), "mixing-plan")
    keys = list(LEVELS)
    joined = rows.join(leaves, keys)
    whole = joined.filter("full_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_epochs") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    part = joined.filter("rest > 0").withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE_HEX))
    sums = part.groupBy(*keys, "slice").agg(F.sum("n_tokens").alias("slice_tokens"), F.first("rest").alias("slice_rest"))
    upto = F.sum("slice_tokens").over(Window.partitionBy(*keys).orderBy("slice"))
    sums = sums.withColumn("before", upto - F.col("slice_tokens")).filter("before <= slice_rest")
    part = part.join(sums.select(*keys, "slice", "slice_tokens", "before"), [*keys, "slice"])
    inside = part.filter("before + slice_tokens <= rest")
    run = F.sum("n_tokens").over(Window.partitionBy(*keys, "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = part.filter("before + slice_tokens > rest").withColumn("upto", F.col("before") + run).filter("upto <= rest")
    out = ["doc_id", *keys, "n_tokens"]
    return (
        whole.select(*out, "epoch")
        .unionByName(inside.select(*out, F.col("full_epochs").alias("epoch")))
        .unionByName(edge.select(*out, F.col("full_epochs").alias("epoch")))
        .withColumnRenamed("doc_id", doc_id)
    )


def _case(column: str, values: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _level_sql(name: str, level: int, weights: dict) -> str:
    """DuckDB CTEs that split the budgets of level - 1 among the nodes of ``level``."""
    keys = ", ".join(LEVELS[: level + 1])
    parents = LEVELS[:level]
    by = f"PARTITION BY {', '.join(parents)} " if parents else ""
    order = f"{by}ORDER BY cap / weight, {LEVELS[level]}"
    up = f"JOIN b{level - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
    return f"""
n{level} AS (
    SELECT c.*, {_case(LEVELS[level], weights, "1")} AS weight, parent_budget
    FROM (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaf GROUP BY {keys}) c {up}
),
w{level} AS (
    SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
           sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n{level}
),
f{level} AS (SELECT *, cap * open <= weight * (parent_budget - used) AS is_full FROM w{level}),
g{level} AS (
    SELECT *, coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0) AS filled, sum(weight) FILTER (NOT is_full) OVER ({by}) AS left_w FROM f{level}
),
b{level} AS (
    SELECT {keys}, tokens, CASE WHEN is_full THEN cap ELSE (weight * (parent_budget - filled)) // left_w END AS parent_budget FROM g{level}
)"""


def oracle_sql() -> str:
    domain = "CASE " + " ".join(
        f"WHEN source <> '' AND right(source, 1) IN ({', '.join(repr(c) for c in d)}) THEN '{n}'" for n, d in reversed(DOMAINS.items())
    ) + " ELSE 'other' END"
    levels = ",".join(_level_sql("", k, w) for k, w in enumerate((DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)))
    levels = levels.replace("JOIN b0 USING", "JOIN (SELECT domain, parent_budget FROM b0) b0 USING").replace(
        "JOIN b1 USING", "JOIN (SELECT domain, lang, parent_budget FROM b1) b1 USING"
    )
    return rf"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
),
r AS (SELECT *, {domain} AS domain FROM d),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS cap FROM r GROUP BY ALL),
total AS (SELECT least(CAST(sum(tokens) AS BIGINT) * {BUDGET_NUM} // {BUDGET_DEN}, CAST(sum(cap) AS BIGINT)) AS parent_budget FROM leaf),{levels},
p AS (
    SELECT domain, lang, source, CASE WHEN tokens > 0 THEN parent_budget // tokens ELSE 0 END AS full_epochs,
           parent_budget - CASE WHEN tokens > 0 THEN parent_budget // tokens ELSE 0 END * tokens AS rest FROM b2
),
j AS (SELECT r.*, full_epochs, rest FROM r JOIN p USING (domain, lang, source)),
whole AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, CAST(full_epochs AS BIGINT))) AS epoch FROM j),
part AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{SEED}:' || CAST(full_epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
        ROWS UNBOUNDED PRECEDING) AS upto FROM j WHERE rest > 0
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) AS epoch FROM whole
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS BIGINT) FROM part WHERE upto <= rest"""
