"""Seeded samples of pairs for audit."""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ContractError


def exact_sample(pairs: DataFrame, size: int, seed: int, key: str = "pair_key") -> DataFrame:
    """(order, key): Python's own simple random sample of the sorted keys, bit for bit.

    The driver draws ranks and brings only their keys from a distributed sort; size is what an audit can read.
    """
    # A row's id is its partition, in the order of the sort, and its place in it.
    ranked = pairs.select(F.col(key).alias("key")).orderBy("key").withColumn("at", F.monotonically_increasing_id()).persist()
    try:
        parts = sorted((r.part, r.n) for r in ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
        ends = list(accumulate(n for _, n in parts))
        total = ends[-1] if ends else 0
        if size > total:
            raise ContractError(f"{size} pairs are asked for; there are {total}")
        wanted = []
        for order, rank in enumerate(random.Random(seed).sample(range(total), size), 1):
            k = bisect_right(ends, rank)
            wanted.append((order, (parts[k][0] << 33) + rank - ends[k] + parts[k][1]))
        chosen = pairs.sparkSession.createDataFrame(wanted, "order int, at long")
        rows = ranked.join(F.broadcast(chosen), "at").select("order", "key").collect()
    finally:
        ranked.unpersist()
    return pairs.sparkSession.createDataFrame(sorted((r.order, r.key) for r in rows), f"order int, {key} string")


def hashed_sample(pairs: DataFrame, size: int, seed: int, key: str = "pair_key") -> DataFrame:
    """A sample without replacement for any size: the least seeded hashes, which any partitioning finds alike."""
    return pairs.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(size).drop("_h")


def sample_summary(sample: DataFrame, query: str = "id_query") -> DataFrame:
    """One row: pairs, queries, and the least and most pairs of a query."""
    per = sample.groupBy(query).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("pairs"), F.count("*").alias("queries"), F.min("n").alias("least"), F.max("n").alias("most"))
