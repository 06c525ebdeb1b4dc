"""Helpers shared by the operators of this subpackage: shared folder, word hashing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import shared_folder

MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir)."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for at most `limit` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` word hashes, in order."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for i in range(size):
                out ^= hashes[i : i + n]
                out *= MIX
                out ^= out >> np.uint64(29)
    return out


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component): smallest node reachable over edges (a, b). One row per node of an edge.

    Every round takes the smallest label among neighbours (partial aggregates: hubs are no hot task), then jumps from label
    to label; each round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = save(both.distinct(), folder, f"{name}-edges")
    labels = save(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        lower = labels.join(near, "node").select("node", F.least("label", "l").alias("next"), "label")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        after = lower.join(jump, "next").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("moved"))
        after = save(after, folder, f"{name}-{step}")
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def offsets(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, dtype=np.int64))]).astype(np.int32)
