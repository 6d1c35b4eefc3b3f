"""Mixing sources to target weights [native]: hierarchical budgeting and seeded epochs.

Every step is a built-in expression; no Python runs on the executors.

*Tree.* Leaves are (domain, lang, source). A node's weight is the product of its
rule-given part and what it has: see :class:`Recipe`. A node can give at most
``max_epochs`` times its tokens.

*Budgeting.* The root gets the budget, at most what it can give. Level by level
a node's budget is split among its children by weight, none above what it can
give; what a full child can't take goes to its siblings by their weights, and
as a node's budget never exceeds what its children can give together, only a
shortage that no sibling can cover reaches the ancestor. The split is the exact
water level: with the children sorted by capacity over weight, child k is full
if its capacity is at most its share of what the children before it leave. All
amounts are integers, so every engine finds the same ones; the remainders of
integer division (fewer tokens than children) are not dealt out.

*Selection.* A leaf's epoch e is its rows in the order of
md5(seed:epoch:doc_id); whole epochs are taken while the budget lasts, of the
last one the longest prefix of rows whose tokens fit, so no row is cut. The
prefix is found without sorting a leaf in one task: rows are counted in
``CELLS`` cells by the head of the hash, the cells are summed, and only the
rows of the cell where the budget ends are put in order.

Tokens are characters / 4, rounded up. Defined cases: a null text counts as
empty and an empty text as one token; null lang or source is the leaf "?";
rows that share a doc_id (or have none) share their place and are ordered by
text; a leaf without budget gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, read_table, whole_text

CELLS = 4096
#: Up to so many leaves the plan is broadcast (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Recipe:
    """Budget and weights. Weights are integers per node value; nodes not named get ``other``."""

    #: Budget in thousandths of all tokens.
    share: int = 600
    max_epochs: int = 2
    seed: int = 11
    domain: dict[str, int] = field(default_factory=lambda: {"core": 3, "web": 2, "misc": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    source: dict[str, int] = field(default_factory=lambda: {"src0": 3})
    other: int = 1


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at its end, every source without one is "misc"."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    k = F.when(number == "", 2).otherwise(number.cast("int") % 3)
    return F.when(k == 0, "core").when(k == 1, "web").otherwise("misc")


def tokens_of(text: Column) -> Column:
    return F.greatest(F.ceil(F.char_length(text) / 4).cast("long"), F.lit(1).cast("long"))


def _weights(node: Column, given: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in given.items():
        out = F.when(node == name, w).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children (``weight``, ``cap``): adds ``alloc``.

    The frame has one row per tree node, never one per document.
    """
    order = Window.partitionBy(*parent).orderBy(F.expr("cap / weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = children.withColumn("left", left).withColumn("weights", weights).withColumn("full", F.expr("cast(cap as decimal(38,0)) * weights <= cast(left as decimal(38,0)) * weight"))
    # full children are a prefix of the order: behind the first that isn't, the level stays
    level = Window.partitionBy(*parent)
    stops = full.withColumn("open_left", F.max(F.when(~F.col("full"), F.col("left"))).over(level)).withColumn("open_weights", F.max(F.when(~F.col("full"), F.col("weights"))).over(level))
    share = F.expr("cast((cast(open_left as decimal(38,0)) * weight) div open_weights as bigint)")
    return stops.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("left", "weights", "full", "open_left", "open_weights")


def leaf_budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """``domain, lang, source, tokens`` -> with ``budget`` of each leaf, from the root down."""
    e = recipe.max_epochs
    level = leaves.groupBy("domain").agg((F.sum("tokens") * e).alias("cap"))
    whole = Window.partitionBy()
    total = F.sum("cap").over(whole)
    start = F.least(F.expr(f"({recipe.share} * sum(cap) over ()) div {1000 * e}"), total)
    level = level.withColumn("budget", start).withColumn("weight", _weights(F.col("domain"), recipe.domain, recipe.other)).withColumn("root", F.lit(0))
    domains = split_budget(level, ["root"], "domain").select("domain", F.col("alloc").alias("budget"))
    level = leaves.groupBy("domain", "lang").agg((F.sum("tokens") * e).alias("cap")).join(domains, "domain")
    level = level.withColumn("weight", _weights(F.col("lang"), recipe.lang, recipe.other))
    langs = split_budget(level, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    level = leaves.withColumn("cap", F.col("tokens") * e).join(langs, ["domain", "lang"])
    level = level.withColumn("weight", _weights(F.col("source"), recipe.source, recipe.other))
    return split_budget(level, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("alloc").alias("budget"))


def _small(plan: DataFrame, name: str) -> DataFrame:
    """A plan of one row per leaf, written once; broadcast where its counted size allows."""
    plan = materialise(plan, name)
    return F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan


def _keyed(docs: DataFrame, recipe: Recipe, names: dict[str, str]) -> DataFrame:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("lang", "source"))
    return docs.withColumns({names["domain"]: domain_of(source), names["lang"]: lang, names["source"]: source, names["tokens"]: tokens_of(whole_text())})


def _hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch they are in, with ``epoch`` and ``n_tokens``.

    Columns of ``docs`` stay as they are; names that clash are lengthened by "_".
    """
    recipe = recipe or Recipe()
    names = {k: free_name(docs, f"mix_{k}") for k in ("domain", "lang", "source", "tokens", "epoch", "hash", "cell", "text")}
    keys = [names["domain"], names["lang"], names["source"]]
    keyed = _keyed(docs, recipe, names)
    leaf = [F.col(names[k]).alias(k) for k in LEVELS]
    leaves = keyed.groupBy(*leaf).agg(F.sum(names["tokens"]).alias("tokens"))
    budgets = leaf_budgets(leaves, recipe)
    # the epoch in which each leaf's budget ends, and what is left of the budget for it
    ends = budgets.select(*LEVELS, F.expr("least(budget div tokens, %d)" % recipe.max_epochs).alias("whole"), F.expr("budget % tokens").alias("rest"))
    ends = _small(ends.withColumn("rest", F.when(F.col("whole") >= recipe.max_epochs, 0).otherwise(F.col("rest"))), "mix-ends")
    cell_of = lambda h: F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    row = keyed.select(*leaf, F.col("doc_id").cast("string").alias("id"), F.col(names["tokens"]).alias("t"))
    placed = row.join(ends, list(LEVELS)).where("rest > 0").withColumn("cell", cell_of(_hash(recipe.seed, F.col("whole"), F.col("id"))))
    cells = placed.groupBy(*LEVELS, "cell", "whole", "rest").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    last = cells.withColumn("upto", F.sum("t").over(upto)).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))).alias("x"))
    plan = ends.join(last.select(*LEVELS, F.col("x.cell").alias("last"), F.col("x.room").alias("room")), list(LEVELS), "left")
    plan = plan.select(*[F.col(k).alias(names[k]) for k in LEVELS], "whole", "rest", "last", "room")
    inner = {k: free_name(docs, f"plan_{k}") for k in ("whole", "rest", "last", "room")}
    plan = plan.select(*keys, *[F.col(k).alias(v) for k, v in inner.items()])
    return _take(docs, keyed.join(_small(plan, "mix-plan"), keys), recipe, names, inner, keys)


def _take(docs: DataFrame, rows: DataFrame, recipe: Recipe, names: dict[str, str], inner: dict[str, str], keys: list[str]) -> DataFrame:
    """Whole epochs, and of the last one the cells before the last cell and a prefix of that cell."""
    whole, rest, last, room = (F.col(inner[k]) for k in ("whole", "rest", "last", "room"))
    epochs = F.when((whole == 0) & (rest <= 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (whole - F.when(rest > 0, 0).otherwise(1)).cast("int")))
    rows = rows.withColumn(names["epoch"], F.explode(epochs))
    rows = rows.withColumn(names["hash"], _hash(recipe.seed, F.col(names["epoch"]), F.col("doc_id")))
    cell = F.conv(F.substring(F.col(names["hash"]), 1, 3), 16, 10).cast("int")
    rows = rows.withColumn(names["cell"], F.when(F.col(names["epoch"]) < whole, -1).when(last.isNull() | (cell < last), -1).otherwise(cell))
    out = [F.col(f"`{c}`") for c in docs.columns] + [F.col(names["epoch"]), F.col(names["tokens"])] + [F.col(k) for k in keys]
    sure = rows.where(F.col(names["cell"]) < 0).select(*out)
    # the cell where the budget ends: about one in CELLS rows of the leaf
    edge = rows.where(F.col(names["cell"]) == last)
    order = Window.partitionBy(*keys).orderBy(names["hash"], F.col("doc_id").cast("string"), whole_text()).rowsBetween(Window.unboundedPreceding, 0)
    upto = free_name(edge, "mix_upto")
    taken = edge.withColumn(upto, F.sum(names["tokens"]).over(order)).where(F.col(upto) <= room).select(*out)
    return sure.unionByName(taken)


def mixed_documents(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """The documents of the mix, same columns; a row comes once for each epoch it is in."""
    return mix(docs, recipe).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and epoch of the mix, with its leaf and tokens."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    m = mix(docs)
    return m.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"))


def _case(column: str, given: dict[str, int], other: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in given.items()) + f" ELSE {other} END"


def _level_sql(name: str, source: str, parent: str, node: str) -> str:
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(cap) OVER b, 0) AS lft, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS wts
  FROM {source} WINDOW b AS (PARTITION BY {parent} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * wts <= CAST(lft AS HUGEINT) * weight AS is_full FROM {name}_a),
{name} AS (SELECT *, CAST(CASE WHEN is_full THEN cap ELSE
    (CAST(max(CASE WHEN NOT is_full THEN lft END) OVER (PARTITION BY {parent}) AS HUGEINT) * weight) // CAST(max(CASE WHEN NOT is_full THEN wts END) OVER (PARTITION BY {parent}) AS HUGEINT) END AS BIGINT) AS alloc FROM {name}_b)"""


def oracle_ctes(recipe: Recipe, source: str = "documents") -> str:
    """DuckDB WITH list that ends in ``mixed``: the rows of ``source`` in the mix, once per epoch."""
    e = recipe.max_epochs
    return f"""
keyed AS (SELECT *, coalesce(source, '?') AS src, coalesce(lang, '?') AS lng,
    CASE WHEN regexp_extract(coalesce(source, '?'), '([0-9]{{1,9}})$', 1) = '' THEN 2 ELSE CAST(regexp_extract(coalesce(source, '?'), '([0-9]{{1,9}})$', 1) AS INT) % 3 END AS dk,
    CAST(greatest(ceil(length(coalesce(text, '')) / 4), 1) AS BIGINT) AS toks FROM {source}),
placed AS (SELECT *, CASE dk WHEN 0 THEN 'core' WHEN 1 THEN 'web' ELSE 'misc' END AS dom FROM keyed),
leaves AS (SELECT dom, lng, src, CAST(sum(toks) AS BIGINT) AS toks FROM placed GROUP BY ALL),
d0 AS (SELECT dom, CAST(sum(toks) AS BIGINT) * {e} AS cap, {_case("dom", recipe.domain, recipe.other)} AS weight, 0 AS root FROM leaves GROUP BY dom),
d1 AS (SELECT *, CAST(least(CAST({recipe.share} * sum(cap) OVER () AS BIGINT) // {1000 * e}, sum(cap) OVER ()) AS BIGINT) AS budget FROM d0),
{_level_sql("dd", "d1", "root", "dom")},
l0 AS (SELECT a.dom, a.lng, a.cap, {_case("a.lng", recipe.lang, recipe.other)} AS weight, dd.alloc AS budget
  FROM (SELECT dom, lng, CAST(sum(toks) AS BIGINT) * {e} AS cap FROM leaves GROUP BY ALL) a JOIN dd USING (dom)),
{_level_sql("ll", "l0", "dom", "lng")},
s0 AS (SELECT a.dom, a.lng, a.src, a.toks, a.toks * {e} AS cap, {_case("a.src", recipe.source, recipe.other)} AS weight, ll.alloc AS budget FROM leaves a JOIN ll USING (dom, lng)),
{_level_sql("ss", "s0", "dom, lng", "src")},
ordered AS (SELECT p.*, ep.epoch, ss.alloc, ss.toks AS leaf_toks,
    sum(p.toks) OVER (PARTITION BY p.dom, p.lng, p.src, ep.epoch ORDER BY md5('{recipe.seed}:' || ep.epoch || ':' || coalesce(CAST(p.doc_id AS VARCHAR), '')), CAST(p.doc_id AS VARCHAR), p.text ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN ss USING (dom, lng, src) CROSS JOIN (SELECT unnest(range({e})) AS epoch) ep),
mixed AS (SELECT * FROM ordered WHERE epoch * leaf_toks + upto <= alloc)"""


ORACLE = f"WITH {oracle_ctes(Recipe())} SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, toks AS n_tokens, dom AS domain, lng AS lang, src AS source FROM mixed"
