"""Mixing sources to target weights: hierarchical budgeting over a domain > language > source tree, native DataFrame operations only.

1. Tokens per leaf are summed; a node's supply is the sum of its leaves' tokens times the number of epochs allowed.
2. From the root down each node's budget goes to its children in proportion to their weights. A child whose supply is less than its
   share gets its supply; what it leaves goes to its siblings. Only what a whole family can't supply is seen one level up, because
   a family's share is limited by its supply there.
3. Each leaf takes whole epochs first and then a token prefix of one more epoch, in an order seeded by (seed, epoch, doc_id).

The order of an epoch is cut into 4096 ranges of the seeded key. Token sums per (leaf, range) are added up over the ranges, so only
the one range in which a leaf's budget ends needs a running sum over rows: a leaf that holds a third of all rows is spread over
its ranges and is never sorted in one task.

All budgets are whole numbers (decimal), so results don't depend on the order of additions; each split is rounded down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import save, shared_dir

#: Target weights by domain and by language (whole numbers; others count 1). Sources of one family weigh the same.
DOMAIN_WEIGHTS = {"web": 5, "news": 3, "books": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, "mix-1"
BROADCAST_LEAVES = 20_000  # up to so many leaves (about 2 MB) their cuts are broadcast; more are joined by shuffle
TOKEN = r"[^\x20\x09-\x0D]+"
PATH = ["domain", "language", "leaf"]


def domain_of(source):
    """The domain of a source by its number modulo 3; sources without a number belong to the web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "web").otherwise(F.element_at(F.array(F.lit("web"), F.lit("news"), F.lit("books")), (number.cast("long") % 3 + 1).cast("int")))


def weight_of(column, weights: dict[str, int]):
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(column == name, F.lit(weight)).otherwise(out)
    return out.cast("decimal(38,0)")


def split_budget(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget` to children (supply, weight, parent's `given`): proportional shares, each limited by its supply.

    Children in order of supply per weight: a child is full when its supply is no more than its share of what the full ones before
    leave; from the first that isn't, all get their share of that rest.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply").cast("double") / F.col("weight").cast("double"), "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    ranked = children.select(
        "*",
        (F.col("given") - F.coalesce(F.sum("supply").over(before), zero)).cast("decimal(38,0)").alias("rest"),
        F.sum("weight").over(onward).cast("decimal(38,0)").alias("weights"),
    ).withColumn("full", F.expr("cast(supply * weights as decimal(38,0)) <= cast(rest * weight as decimal(38,0))"))
    family = Window.partitionBy(*parent)
    first = ranked.select(
        "*",
        F.max(F.when(~F.col("full"), F.struct(F.col("weights"), F.col("rest")))).over(family).alias("open"),
    )
    share = F.expr("cast((open.rest * weight) div open.weights as decimal(38,0))")
    budget = F.when(F.col("open").isNull() | (F.col("weights") > F.col("open.weights")), F.col("supply")).otherwise(F.least("supply", share))
    return first.withColumn("budget", F.greatest(budget.cast("decimal(38,0)"), zero)).drop("rest", "weights", "full", "open")


def leaf_budgets(leaves: DataFrame, percent: int, epochs: int, domain_weights: dict[str, int], language_weights: dict[str, int]) -> DataFrame:
    """(domain, language, leaf, tokens, budget) from (domain, language, leaf, tokens)."""
    whole = "decimal(38,0)"
    supply = leaves.withColumn("supply", (F.col("tokens") * epochs).cast(whole))
    total = supply.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast(whole).alias("all"))
    top = supply.groupBy("domain").agg(F.sum("supply").cast(whole).alias("supply")).crossJoin(F.broadcast(total))  # one row
    top = top.select("domain", "supply", F.expr(f"cast(least((all * {percent}) div 100, all * {epochs}) as {whole})").alias("given"), F.col("domain").alias("child"), F.lit(0).alias("root"))
    domains = split_budget(top.withColumn("weight", weight_of(F.col("domain"), domain_weights)), ["root"]).select("domain", F.col("budget").alias("given"))
    middle = supply.groupBy("domain", "language").agg(F.sum("supply").cast(whole).alias("supply")).join(domains, "domain")
    middle = middle.withColumn("child", F.col("language")).withColumn("weight", weight_of(F.col("language"), language_weights))
    languages = split_budget(middle, ["domain"]).select("domain", "language", F.col("budget").alias("given"))
    bottom = supply.join(languages, ["domain", "language"]).withColumn("child", F.col("leaf")).withColumn("weight", F.lit(1).cast(whole))
    return split_budget(bottom, ["domain", "language"]).select("domain", "language", "leaf", "tokens", "budget")


def mix(
    docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: str = SEED,
    domain_weights: dict[str, int] | None = None, language_weights: dict[str, int] | None = None,
) -> DataFrame:
    """Rows of `docs`, each once per epoch in which it is taken, with `epoch` (from 0), `tokens` and `mix_domain` added.

    The budget is `percent` of all tokens. A row is taken when the tokens of its leaf before it, over all epochs, are under the leaf's budget,
    so a leaf may exceed its budget by less than one row. Null text has no tokens and is never taken; null language or source counts
    as `unknown`. Rows with equal ids and texts are taken in turn (they have equal keys; ties go by key and text, and equal rows are alike).
    Columns of the input named epoch, tokens or mix_domain are replaced.
    """
    docs = docs.drop("epoch", "tokens", "mix_domain")
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("long").alias("tokens")
    place = [
        domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.coalesce("source", F.lit("unknown")).alias("leaf"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
    ]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), tokens, *place).filter("tokens > 0")

    def dealt(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
        frame = frame.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("id"))))
        return frame.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))

    folder = shared_dir(docs.sparkSession)
    sums = save(dealt(docs.select(tokens, *place).filter("tokens > 0")).groupBy(*PATH, "epoch", "bucket").agg(F.sum("tokens").alias("tokens")), folder, "sums")
    leaves = sums.filter("epoch = 0").groupBy(*PATH).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, percent, epochs, domain_weights or DOMAIN_WEIGHTS, language_weights or LANGUAGE_WEIGHTS)
    order = Window.partitionBy(*PATH).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(budgets.select(*PATH, F.col("budget").cast("long").alias("budget")), PATH)
    cut = F.min(F.when(F.expr("before + tokens > budget"), F.struct("epoch", "bucket", "before"))).alias("cut")
    cuts = save(ranges.groupBy(*PATH, "budget").agg(cut), folder, "cuts")  # the first range a leaf can't take whole; null: it takes all
    if cuts.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        cuts = F.broadcast(cuts)
    cuts = cuts.select(*PATH, "budget", F.coalesce("cut.epoch", F.lit(epochs)).alias("last_epoch"), F.coalesce("cut.bucket", F.lit(0)).alias("last_bucket"), "cut.before")

    chosen = dealt(rows.join(cuts, PATH))
    whole = chosen.filter("epoch < last_epoch or (epoch = last_epoch and bucket < last_bucket)")
    inside = Window.partitionBy(*PATH, "epoch", "bucket").orderBy("key", "id", F.md5("doc.text")).rowsBetween(Window.unboundedPreceding, -1)
    part = chosen.filter("epoch = last_epoch and bucket = last_bucket").withColumn("sofar", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).filter("sofar < budget").drop("sofar")
    return whole.unionByName(part).select("doc.*", "epoch", "tokens", F.col("domain").alias("mix_domain"))
