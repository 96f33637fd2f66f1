"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The leaves of a tree (domain, language, source) hold documents with token counts.
A token budget flows from the root: among siblings it is split by weight, no node
gets more than its subtree can give (tokens times ``max_epochs``), and what one
cannot take goes to its siblings by weight before any of it goes further up; for a
set of siblings that is one water level, ``least(capacity, weight * level)``.

A leaf reads as many whole epochs as its budget holds, then the longest prefix of
one more epoch that fits, in that epoch's seeded order (a hash of seed, epoch and
key).  The prefix's end is found in two steps, by hash bucket and then inside the
one bucket where the budget runs out, so no task holds a leaf.  What is left is one
order value per leaf, and the selection itself is a filter that shuffles nothing.

Nulls: a null level is a node of its own, named ''; a null key orders as ''; a
null text has no tokens.  A leaf without tokens gives no rows.  Rows with equal
keys stand or fall together.  Columns of the operator's own names are replaced, all
others kept.  Nodes without a weight in ``weights`` weigh 1; a
weight of 0 or less takes nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.llm.shared import settled, table

#: Hex digits of the order value that make a bucket.
BUCKET_DIGITS = 3
#: Leaves up to which the plan is broadcast.
BROADCAST_LEAVES = 50_000


def order_value(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def _weight(level: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(level == name, F.lit(float(w))).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parents: list[str], node: str, budget: str) -> DataFrame:
    """Adds ``share`` to siblings (rows equal in ``parents``) from weight, capacity and their parent's budget."""
    by = [F.col(p) for p in parents]
    order = Window.partitionBy(*by).orderBy(F.col("capacity") / F.col("weight"), node)
    taken = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.where("weight > 0").withColumn("_level", (F.col(budget) - taken) / open_weight)
    return level.withColumn("share", F.least(F.col("capacity"), F.col("weight") * F.max("_level").over(Window.partitionBy(*by)))).drop("_level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """Whole tokens that each leaf is to give; leaves: the levels and ``have``."""
    rows = leaves.withColumn("capacity", (F.col("have") * max_epochs).cast("double"))
    top = rows.agg(F.coalesce(budget, F.lit(0)).cast("double").alias("_budget"))
    parents = top
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = rows.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights[depth]))
        nodes = nodes.crossJoin(F.broadcast(top)) if depth == 0 else nodes.join(parents, levels[:depth])
        parents = water_fill(nodes, levels[:depth], level, "_budget").select(*path, F.col("share").alias("_budget"))
    return leaves.join(parents, levels).withColumn("budget", F.floor("_budget")).drop("_budget")


def plan(sized: DataFrame, levels: list[str], weights: list[dict[str, float]], budget: Column, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: whole epochs and the last order value of the open one.

    sized: ``_key``, the levels and ``_tokens``; budget: an aggregate over leaves with ``have``.
    """
    leaves = settled(sized.groupBy(*levels).agg(F.sum("_tokens").alias("have")).where("have > 0"), "mix-leaves")
    budgets = leaf_budgets(leaves, levels, weights, budget, max_epochs)
    whole = F.least(F.floor(F.col("budget") / F.col("have")), F.lit(max_epochs))
    goals = settled(budgets.withColumn("epochs", whole).withColumn("rest", F.when(whole < max_epochs, F.col("budget") - whole * F.col("have")).otherwise(0)), "mix-goals")
    small = F.broadcast if goals.count() <= BROADCAST_LEAVES else lambda df: df
    ordered = sized.join(small(goals.select(*levels, "epochs", "rest")), levels).where("rest > 0").withColumn("_order", order_value(F.col("_key"), F.col("epochs"), seed))
    ordered = ordered.withColumn("_bucket", F.left("_order", F.lit(BUCKET_DIGITS)))
    along = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = ordered.groupBy(*levels, "_bucket", "rest").agg(F.sum("_tokens").alias("_n")).withColumn("_upto", F.sum("_n").over(along))
    buckets = settled(buckets, "mix-buckets")
    full = buckets.where("_upto <= rest").groupBy(*levels).agg(F.max("_bucket").alias("_full"))
    cut = buckets.where("_upto > rest AND _upto - _n < rest").select(*levels, "_bucket", (F.col("rest") - F.col("_upto") + F.col("_n")).alias("_left"))
    inside = Window.partitionBy(*levels, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        ordered.join(small(cut), [*levels, "_bucket"]).groupBy(*levels, "_bucket", "_left", "_order").agg(F.sum("_tokens").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(inside)).where("_upto <= _left").groupBy(*levels).agg(F.max("_order").alias("_last"))
    )
    ends = goals.select(*levels, "epochs").join(full, levels, "left").join(last, levels, "left")
    # every order value of a full bucket is below the bucket's digits followed by 'g'
    return ends.select(*levels, "epochs", F.coalesce("_last", F.concat("_full", F.lit("g")), F.lit("")).alias("last"))


def mix(docs: DataFrame, key: str, text: str, levels: dict[str, Column], weights: list[dict[str, float]], budget_share: float, max_epochs: int = 1, seed: int = 11, tokens: Column | None = None, added: tuple[str, str] = ("epoch", "mix_tokens")) -> DataFrame:
    """The selected documents with all their columns, the epoch, and the tokens counted; ``added`` names these two.

    levels: named columns of the tree, from the root; budget_share: of all tokens;
    tokens: per row, a quarter of the text's bytes where not given.
    """
    amount = tokens if tokens is not None else F.ceil(F.octet_length(F.col(text)) / 4)
    names = [f"_level_{k}" for k in range(len(levels))]
    columns = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # apart from the operator's own columns, whatever its columns are called
    marked = docs.select(row.alias("_row"), F.col(key).alias("_key"), *columns, F.coalesce(amount, F.lit(0)).cast("long").alias("_tokens"))
    sized = settled(marked.select("_key", *names, "_tokens"), "mix-sizes")
    budget = F.floor(F.sum("have") * F.lit(budget_share))
    leaves = settled(plan(sized, names, weights, budget, max_epochs, seed), "mix-plan")
    small = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    times = F.col("epochs") + F.when(order_value(F.col("_key"), F.col("epochs"), seed) <= F.col("last"), 1).otherwise(0)
    out = marked.join(small, names).withColumn("_times", times.cast("int")).where("_times > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("_times") - 1)) if max_epochs > 1 else F.lit(0)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return out.select(*kept, epoch.alias(added[0]), F.col("_tokens").alias(added[1]))


# ---- the query ---------------------------------------------------------------

#: Sources below this number are the web domain.
WEB_SOURCES = 10
DOMAINS = {"web": 0.6, "curated": 0.4}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
SHARE, EPOCHS, SEED = 0.8, 2, 11
_DOMAIN = f"CASE WHEN try_cast(substr(source, 4) AS INT) < {WEB_SOURCES} THEN 'web' ELSE 'curated' END"


def tree() -> dict[str, Column]:
    return {"domain": F.expr(_DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op4_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights, up to two epochs of each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    chosen = mix(docs, "doc_id", "text", tree(), [DOMAINS, LANGUAGES, {}], SHARE, EPOCHS, SEED)
    return chosen.select("doc_id", F.expr(_DOMAIN).alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"), "epoch")


def _fill(name: str, source: str, parents: list[str], node: str, weight: str, budget: str) -> str:
    """SQL of one level: water level among siblings, then shares."""
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    path = ", ".join([*parents, node])
    return f"""
{name}_level AS (
    SELECT *, ({budget} - coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER ({by} ORDER BY capacity / weight, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM (SELECT {path}, sum(capacity) AS capacity, {weight} AS weight, any_value({budget}) AS {budget} FROM {source} GROUP BY {path})),
{name} AS (SELECT {path}, least(capacity, weight * max(level) OVER ({by})) AS share_{node} FROM {name}_level)"""


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN CAST({v} AS DOUBLE)' for k, v in weights.items())} ELSE CAST(1 AS DOUBLE) END" if weights else "CAST(1 AS DOUBLE)"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(ceil(strlen(text) / 4), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS have, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS capacity FROM d GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT *, (SELECT CAST(floor(sum(have) * CAST({SHARE} AS DOUBLE)) AS DOUBLE) FROM leaf) AS budget FROM leaf),
{_fill("a", "root", [], "domain", _case("domain", DOMAINS), "budget")},
two AS (SELECT leaf.*, share_domain FROM leaf JOIN a USING (domain)),
{_fill("b", "two", ["domain"], "lang", _case("lang", LANGUAGES), "share_domain")},
three AS (SELECT leaf.*, share_lang FROM leaf JOIN b USING (domain, lang)),
{_fill("c", "three", ["domain", "lang"], "source", _case("source", {}), "share_lang")},
goal AS (SELECT *, CAST(least(floor(floor(share_source) / have), {EPOCHS}) AS BIGINT) AS epochs FROM leaf JOIN c USING (domain, lang, source)),
goals AS (SELECT domain, lang, source, epochs, CASE WHEN epochs < {EPOCHS} THEN floor(share_source) - epochs * have ELSE 0 END AS rest FROM goal),
o AS (SELECT d.*, epochs, rest, md5('{SEED}:' || epochs || ':' || doc_id) AS place FROM d JOIN goals USING (domain, lang, source)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AND rest > 0 AS taken FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INT) AS epoch
FROM (SELECT *, unnest(range(0, epochs + CAST(taken AS INT))) AS epoch FROM p)
"""
