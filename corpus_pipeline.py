"""Training-data pipeline over `documents`: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder and rereads it for the next.
Tables beside `docs` (labels, benchmark) come from sf_dir. All but the last stage return the columns of `docs`, which may hold
nulls, empty or very long texts, repeated rows and further columns; an empty table gives an empty table.

A document is an id with a text. Rows without an id and rows that share one get a key of their own (`row_keys`), so each is judged by its own text: of
rows with the same id and text, or with no id and the same text, one stays after the near-duplicate stage; where one id has two texts
only the copy or the contaminated one goes.
"""

from __future__ import annotations

from palisade.llm.common import save, shared_dir
from palisade.llm.decontaminate import contaminated
from palisade.llm.mixing import mix
from palisade.llm.ngram_join import jaccard_components
from palisade.llm.pii import mask_pii
from palisade.llm.toxicity import drop_toxic, toxicity_model
from palisade.sources.tables import table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_keys(docs: DataFrame, folder: str) -> DataFrame:
    """(_kid, _kdigest, _k): id, text digest and key of the documents whose doc_id is null or stands in several rows; empty for a table with an id per row.

    Keys are numbers from the lowest long on, which ids of documents are not to use.
    """
    several = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1")
    found = docs.join(several, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(docs.filter("doc_id is null"))
    distinct = found.select(F.col("doc_id").cast("long").alias("_kid"), F.sha2(F.col("text"), 256).alias("_kdigest")).distinct()
    return save(distinct.withColumn("_k", F.expr("-9223372036854775807 + monotonically_increasing_id()")), folder, "keys")


def with_key(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """`docs` with `_key`: the doc_id, or the key of `keys` for a document that has one; `_own` tells which."""
    if keys is None:
        return docs.withColumn("_key", F.col("doc_id").cast("long")).withColumn("_own", F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col("_kid")) & F.sha2(F.col("text"), 256).eqNullSafe(F.col("_kdigest"))
    joined = docs.join(keys, same, "left").drop("_kid", "_kdigest")
    return joined.withColumn("_own", F.col("_k").isNotNull()).withColumn("_key", F.coalesce("_k", F.col("doc_id").cast("long"))).drop("_k")


def without(docs: DataFrame, keys: DataFrame | None, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose key is not in `gone` (key)."""
    gone = gone.select(F.col("key").alias("_gone")).distinct()
    return with_key(docs, keys).join(gone, F.col("_key") == F.col("_gone"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labels outside the held-out fold calls toxic go."""
    return drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def keys_of(docs: DataFrame) -> DataFrame | None:
    keys = row_keys(docs, shared_dir(docs.sparkSession))
    return None if keys.isEmpty() else keys


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (without ids: any one of them)."""
    keys = keys_of(docs)
    found = jaccard_components(with_key(docs, keys).select(F.col("_key").alias("doc_id"), "text"))
    if keys is None:
        return without(docs, keys, found.filter("component_id <> doc_id").select(F.col("doc_id").alias("key"))).select(*docs.columns)
    ids = found.select("doc_id", "component_id").distinct().join(keys.select(F.col("_k").alias("doc_id"), F.col("_kid").alias("id"), F.lit(True).alias("own")), "doc_id", "left")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    ids = save(ids.withColumn("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("doc_id"))).select("doc_id", "component_id", rank.alias("rank")), shared_dir(spark), "ranks")
    first = ids.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = ids.join(first, "component_id").filter(F.col("rank") != F.col("first")).select(F.col("doc_id").alias("key"))
    kept = without(docs, keys, gone)
    once = kept.filter("_own").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.filter("not _own").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, go."""
    keys = keys_of(docs)
    found = contaminated(with_key(docs, keys).select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, keys, found.select(F.col("doc_id").alias("key"))).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` is masked; `n_chars` follows where the text changed."""
    masked = mask_pii(docs.withColumn("_before", F.length("text")))
    changed = F.length("text") != F.col("_before")
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop("_before")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one row per epoch in which a document is taken."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("mixing_sources", mixing),
]

#: The toxicity stage is a trained model, which SQL can't express; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), folder, name)
    return docs
