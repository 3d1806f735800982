"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

The tree is root, domain, language, source. A node's capacity is what its leaves can give: their tokens times the most
epochs. The root's budget goes down level by level, split by the siblings' weights; a child that cannot use its share
gives what is over to its siblings, in proportion to their weights, and since a node's capacity counts its whole
subtree, only what a whole family cannot use goes back up to the aunts. One level is one closed form: siblings in the
order of capacity by weight, the full ones first, and `level` the common share per weight of the others.

A leaf with a budget of b tokens and a supply of t gives b div t whole epochs, and from the epoch after these a prefix:
documents in the order of md5(seed:epoch:id), each taken while fewer than b mod t tokens precede it. The prefix is a
single cut key for each leaf, found from token sums by key range and then within one range, so no task sorts a leaf and
a hot source is summed before it is shuffled. The cut makes the choice a narrow comparison on the document rows.

Defined results: null text: no tokens; null levels count as ''; rows of equal ids have equal keys and are taken
together; rows without tokens follow their key like others; a leaf without tokens or weight gives nothing. Empty table:
no rows. Columns of the input keep their names, whatever these are: they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.common import WORD, written

LEVELS = ["mix__domain", "mix__lang", "mix__source"]


@dataclass(frozen=True)
class Mix:
    """weights: by level (0 domain, 1 language, 2 source), the node's name to its weight; others have 1. budget_share: of all tokens."""

    weights: tuple[Mapping[str, float], ...] = ({}, {}, {})
    budget_share: float = 0.6
    max_epochs: int = 2
    seed: int = 17
    domain: Column | None = field(default=None, compare=False)


def _leaf(mix: Mix, lang_col: str, source_col: str) -> list[Column]:
    """The leaf's three columns, from those of the documents."""
    domain = mix.domain if mix.domain is not None else F.lit("all")
    return [F.coalesce(c.cast("string"), F.lit("")).alias(level) for c, level in zip((domain, F.col(lang_col), F.col(source_col)), LEVELS)]


def _weight(names: Mapping[str, float], level: str) -> Column:
    found = F.lit(1.0)
    for name, weight in names.items():
        found = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(found)
    return found


def _share(nodes: DataFrame, parents: list[str], level: str, weights: Mapping[str, float]) -> DataFrame:
    """nodes with columns parents, level, capacity and budget (the parent's); budget becomes the node's own."""
    nodes = nodes.withColumn("weight", _weight(weights, level)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = Window.partitionBy(*parents).orderBy("ratio", level)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("nth", F.row_number().over(order)).withColumn("rest", F.sum("weight").over(after))
    nodes = nodes.withColumn("level", F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.col("rest")).otherwise(F.lit(0.0)))
    first = F.min(F.when((F.col("weight") > 0) & (F.col("ratio") > F.col("level")), F.struct("nth", "level"))).over(Window.partitionBy(*parents))["level"]
    own = F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(F.col("capacity"), F.coalesce(F.col("weight") * first, F.col("capacity"))))
    return nodes.withColumn("budget", own).select(*parents, level, "capacity", "budget")


def leaf_budgets(supplies: DataFrame, mix: Mix) -> DataFrame:
    """supplies: one row for each leaf with LEVELS and tokens. Adds budget (long), whole (epochs) and part (tokens of the epoch after them)."""
    leaves = supplies.withColumn("capacity", F.col("tokens").cast("double") * mix.max_epochs)
    langs = leaves.groupBy(*LEVELS[:2]).agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy(LEVELS[0]).agg(F.sum("capacity").alias("capacity"))
    everything = F.sum("capacity").over(Window.partitionBy())
    domains = domains.withColumn("budget", F.floor(everything / mix.max_epochs * mix.budget_share).cast("double"))
    domains = _share(domains, [], LEVELS[0], mix.weights[0])
    langs = _share(langs.join(domains.select(LEVELS[0], "budget"), LEVELS[:1]), LEVELS[:1], LEVELS[1], mix.weights[1])
    given = _share(leaves.join(langs.select(*LEVELS[:2], "budget"), LEVELS[:2]).select(*LEVELS, "capacity", "budget"), LEVELS[:2], LEVELS[2], mix.weights[2])
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    given = supplies.join(given.select(*LEVELS, F.floor("budget").cast("long").alias("budget")), LEVELS)
    return given.withColumn("whole", whole.cast("int")).withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens"))


def _key(mix: Mix, id_col: str, epoch: str) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col(epoch).cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def leaf_plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The counted rows (id, LEVELS, n_tokens), and for each leaf budget, whole and cut, both as written tables."""
    counted = docs.select(F.col(id_col).alias("id"), *_leaf(mix, lang_col, source_col), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    counted = written(counted, "counted")
    budgets = written(leaf_budgets(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mix), "budgets")
    keyed = counted.join(budgets.where("part > 0").select(*LEVELS, "whole", "part"), LEVELS).withColumn("key", _key(mix, "id", "whole")).withColumn("range", F.substring("key", 1, 3))
    ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("tokens"), F.first("part").alias("part"))
    ahead = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ranges.withColumn("ahead", ahead).where("ahead < part").groupBy(*LEVELS).agg(F.max("range").alias("range"), F.max_by("ahead", "range").alias("ahead"))
    edge = keyed.join(last, [*LEVELS, "range"]).groupBy(*LEVELS, "key").agg(F.sum("n_tokens").alias("tokens"), F.first("part").alias("part"), F.first("ahead").alias("ahead"))
    start = F.col("ahead") + F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = edge.withColumn("start", start).where("start < part").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return counted, written(budgets.join(cuts, LEVELS, "left").select(*LEVELS, "budget", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "plan")


def _copies(rows: DataFrame, plan: DataFrame, mix: Mix, id_col: str) -> DataFrame:
    """rows (with LEVELS) once for each epoch in which they are taken, numbered in mix__epoch."""
    plan = plan.select(*LEVELS, F.col("budget").alias("mix__budget"), F.col("whole").alias("mix__whole"), F.col("cut").alias("mix__cut"))
    taken = rows.join(plan, LEVELS).withColumn("mix__times", F.col("mix__whole") + (_key(mix, id_col, "mix__whole") <= F.col("mix__cut")).cast("int"))
    return taken.where("mix__times > 0").withColumn("mix__epoch", F.explode(F.sequence(F.lit(0), F.col("mix__times") - 1)))


def mixture(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each document and epoch that is taken: id, domain, lang, source, n_tokens, leaf_budget, epoch."""
    counted, plan = leaf_plan(docs, mix, id_col, text_col, lang_col, source_col)
    names = [F.col(c).alias(c.removeprefix("mix__")) for c in LEVELS]
    return _copies(counted, plan, mix, "id").select(F.col("id").alias(id_col), *names, "n_tokens", F.col("mix__budget").alias("leaf_budget"), F.col("mix__epoch").alias("epoch"))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are taken, with their own columns only, once for each epoch."""
    _, plan = leaf_plan(docs, mix, id_col, text_col, lang_col, source_col)
    rows = docs.select(F.struct("*").alias("mix__row"), F.col(id_col).alias("mix__id"), *_leaf(mix, lang_col, source_col))
    return _copies(rows, plan, mix, "mix__id").select("mix__row.*")


def mixture_sql(documents: str, domain: str, mix: Mix) -> str:
    """DuckDB SQL of mixture() for a table expression with doc_id, text, lang and source; domain is an SQL expression."""

    def weight(level: int, name: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in mix.weights[level].items())
        return f"(CASE {name} {cases} ELSE 1.0 END)::DOUBLE" if cases else "1.0::DOUBLE"

    def share(name: str, nodes: str, keys: str, level: str, n: int) -> str:
        part = f"PARTITION BY {keys}" if keys else ""
        return f"""
{name}_w AS (SELECT *, {weight(n, level)} AS w FROM ({nodes})),
{name}_r AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END AS ratio FROM {name}_w),
{name}_l AS (SELECT *, row_number() OVER (o) AS nth,
  CASE WHEN sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0
    THEN greatest(0.0, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 0.0 END AS lvl
  FROM {name}_r WINDOW o AS ({part} ORDER BY ratio, {level})),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN w <= 0 THEN 0.0 ELSE least(cap, coalesce(w * open_level, cap)) END AS budget
  FROM (SELECT *, (min(CASE WHEN w > 0 AND ratio > lvl THEN {{'nth': nth, 'lvl': lvl}} END) OVER ({part})).lvl AS open_level FROM {name}_l))"""

    return f"""WITH counted AS (SELECT doc_id, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {documents}),
supply AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
leaf AS (SELECT *, tokens::DOUBLE * {mix.max_epochs} AS cap FROM supply),
lang0 AS (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL),
dom0 AS (SELECT domain, sum(cap) AS cap FROM lang0 GROUP BY ALL),
{share("dom", f"SELECT *, floor(sum(cap) OVER () / {mix.max_epochs} * {mix.budget_share})::DOUBLE AS budget FROM dom0", "", "domain", 0)},
{share("lng", "SELECT l.*, d.budget FROM lang0 l JOIN dom d USING (domain)", "domain", "lang", 1)},
{share("src", "SELECT l.*, g.budget FROM leaf l JOIN lng g USING (domain, lang)", "domain, lang", "source", 2)},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN bud // tokens ELSE 0 END AS whole, bud - CASE WHEN tokens > 0 THEN bud // tokens ELSE 0 END * tokens AS part
  FROM (SELECT *, floor(budget)::BIGINT AS bud FROM src)),
keyed AS (SELECT c.*, p.bud, p.whole, p.part, md5('{mix.seed}:' || p.whole || ':' || coalesce(c.doc_id::VARCHAR, '')) AS key FROM counted c JOIN plan p USING (domain, lang, source)),
started AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS start FROM keyed),
timed AS (SELECT *, whole + CASE WHEN part > 0 AND start < part THEN 1 ELSE 0 END AS times FROM started)
SELECT doc_id, domain, lang, source, n_tokens, bud AS leaf_budget, unnest(range(times))::INTEGER AS epoch FROM timed WHERE times > 0"""
