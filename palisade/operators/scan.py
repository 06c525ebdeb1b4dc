"""Running aggregates and bounded top-n per key that do not put a whole key into one task.

A key may hold a large share of all rows, so each key is cut into buckets along its order. Windows run inside a
bucket; one small row per bucket carries the state of the buckets before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS_PER_BUCKET = 4096


def only(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition over derived columns.

    A plain filter would be pushed below the projections that derive them, copying their expressions into it; an
    emptied generator stays where it is.
    """
    return df.withColumn("_keep", F.explode(F.when(condition, F.array(F.lit(1))))).drop("_keep")


def turn_bucket(width: int = TURNS_PER_BUCKET) -> Column:
    return F.floor(F.col("turn") / width)


def hour_bucket(ts_ms: str = "ts_ms") -> Column:
    return F.floor(F.col(ts_ms) / 3_600_000)


def _fold(how: str, value: Column, order: list[str]) -> Column:
    if how == "sum":
        return F.sum(value)
    if how == "max":
        return F.max(value)
    if how == "min":
        return F.min(value)
    if how == "last":
        return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("v"))))
    raise ValueError(how)


def _merge(how: str, local: Column, carried: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if how == "max":
        return F.greatest(local, carried)
    if how == "min":
        return F.least(local, carried)
    return F.coalesce(local["v"], carried["v"])


def running(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, aggs: dict[str, tuple]
) -> DataFrame:
    """Add running columns; aggs maps name -> (how, value, include_current), how in sum, max, min, last.

    ``last`` keeps the latest value that is not null. Rows must be unique on keys + order.
    """
    cut = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    local = {
        f"_l_{name}": _fold(how, value, order).over(
            inside.rowsBetween(W.unboundedPreceding, 0 if include else -1)
        )
        for name, (how, value, include) in aggs.items()
    }
    totals = cut.groupBy(*keys, "_bucket").agg(
        *[_fold(how, value, order).alias(f"_t_{name}") for name, (how, value, _) in aggs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_bucket",
        *[
            (F.max if how == "last" else getattr(F, how))(f"_t_{name}").over(before).alias(f"_c_{name}")
            for name, (how, _, _) in aggs.items()
        ],
    )
    joined = cut.withColumns(local).join(carried, [*keys, "_bucket"], "left")
    out = [
        _merge(how, F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name) for name, (how, _, _) in aggs.items()
    ]
    return joined.select(*df.columns, *out)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, bucket: Column) -> DataFrame:
    """First n rows per key by order: n per bucket first, then n over the survivors."""
    first = W.partitionBy(*keys, "_bucket").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= n)
        .drop("_bucket", "_rn")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
