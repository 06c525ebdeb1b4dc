"""URL filters: listed host/path rules first, then association rules mined by Spark's FP-growth; native DataFrame operations only.

A labelled URL is a transaction of its tokens (host, top domain, last two labels, every label before the top one, first path part, path shape,
extension, query keys) and of the item `label=block` where its label says so. FP-growth finds the frequent item sets, of any
size; a set of tokens is a rule when, together with the label, it reaches the support and, relative to the set alone, the
confidence. A rule that is no more confident than a rule over part of its tokens is pruned.

Rules are matched by an inverted index (token -> rules): the distinct token sets of all pages are joined on tokens and a rule fires when
all its tokens are hit. Pages with equal token sets are judged once, so a host with a third of all pages costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import save, shared_dir

#: Fixed values: (host, path, verdict). A rule fits its host and all subdomains when the path starts with the rule's; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.005, 0.5
LABEL = "label=block"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and query of `url`; null or without `://`: empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    query = F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)
    return pages.withColumns({"host": lower_ascii(host), "path": path, "query": query})


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0]))

    def pick(value) -> Column:
        fits = [(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), value(h, p, v)) for h, p, v in ordered]
        return reduce(lambda out, case: F.when(case[0], F.lit(case[1])).otherwise(out), reversed(fits), F.lit(None).cast("string"))

    return pick(lambda h, p, v: h + p), pick(lambda h, p, v: v)


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Sorted distinct tokens of a URL; numbers in a path part count as one shape."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = F.regexp_replace(F.array_join(F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9]+", "9"), "[^0-9./]+", "a")), "/"), "^$", "-")
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^([^=]*)", 1)))
    tokens = F.concat(
        F.array(
            F.concat(F.lit("top="), F.element_at(labels, -1)),
            F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")),
            F.concat(F.lit("host="), host),
            F.concat(F.lit("first="), F.coalesce(F.get(parts, F.lit(0)), F.lit("-"))),
            F.concat(F.lit("shape="), shape),
            F.concat(F.lit("ext="), F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("-"))),
        ),
        F.transform(F.slice(labels, 1, n - 1), lambda x: F.concat(F.lit("label="), x)),
        keys,
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def mine_sets(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, n_tokens, confidence, is_rule) from (tokens, blocked): token sets that reach the support together with the label."""
    items = labelled.filter("size(tokens) > 0").select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).freqItemsets
    sets = sets.withColumn("tokens", F.array_sort(F.array_remove("items", LABEL))).withColumn("labelled", F.array_contains("items", LABEL))
    sets = sets.filter(F.size("tokens") > 0).groupBy("tokens")
    both = sets.agg(F.max(F.when(F.col("labelled"), F.col("freq"))).alias("hits"), F.max(F.when(~F.col("labelled"), F.col("freq"))).alias("seen")).filter("hits is not null")
    return both.select("tokens", F.size("tokens").alias("n_tokens"), (F.col("hits") / F.col("seen")).alias("confidence"), F.expr(f"hits >= {confidence} * seen").alias("is_rule"))


def prune_rules(sets: DataFrame, folder: str) -> DataFrame:
    """(tokens, n_tokens) of the rules among `sets` that are more confident than every rule over part of their tokens.

    Every part of a frequent set is frequent, so going up by size the best confidence below a set is that of the sets with one token less.
    """
    largest = sets.agg(F.max("n_tokens")).first()[0] or 0
    below, kept = None, []
    for n in range(1, largest + 1):
        level = sets.filter(F.col("n_tokens") == n)
        if below is None:
            level = level.withColumn("under", F.lit(0.0))
        else:
            parts = level.select(F.col("tokens").alias("whole"), F.explode("tokens").alias("out")).select("whole", F.expr("filter(whole, x -> x <> out)").alias("tokens"))
            best = parts.join(below.select("tokens", "best"), "tokens").groupBy("whole").agg(F.max("best").alias("under")).withColumnRenamed("whole", "tokens")
            level = level.join(best, "tokens")
        level = level.withColumn("best", F.greatest("under", F.when(F.col("is_rule"), F.col("confidence")).otherwise(0.0)))
        below = save(level.select("tokens", "n_tokens", "best", (F.col("is_rule") & (F.col("confidence") > F.col("under"))).alias("keep")), folder, f"sets-{n}")
        kept.append(below.filter("keep").select("tokens", "n_tokens"))
    return reduce(DataFrame.unionByName, kept) if kept else sets.select("tokens", "n_tokens").limit(0)


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of `pages` (page_id, url): host, path, rule, verdict, mined.

    verdict is the listed rule's, else block where a mined rule fires, else allow. `labels` (page_id, blocked): pages without a label, or with
    a null one, teach nothing; a page labelled more than once is blocked if any label says so. Null or broken URLs have empty parts, no
    tokens and are allowed. Repeated pages are each answered; null ids too. No labels or no pages: no mined rules.
    """
    folder = shared_dir(pages.sparkSession)
    parts = with_parts(pages.select("page_id", "url"))
    judged = parts.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("query")))
    known = labels.filter("page_id is not null and blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = save(judged.filter("page_id is not null").join(known, "page_id").select("tokens", "blocked"), folder, "labelled")
    mined = prune_rules(save(mine_sets(labelled, support, confidence), folder, "sets"), folder)
    index = mined.select(F.array_join("tokens", " ").alias("mined"), "n_tokens", F.explode("tokens").alias("token"))
    urls = judged.select("tokens").filter("size(tokens) > 0").distinct()
    hits = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "mined", "n_tokens").agg(F.count("*").alias("n"))
    fired = hits.filter("n = n_tokens").groupBy("tokens").agg(F.min("mined").alias("mined"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    out = judged.join(fired, "tokens", "left")
    return out.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("mined"),
    )
