"""Ranking effectiveness and diversity of retrieval profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


def per_query(ranks: DataFrame, relevance: DataFrame, cutoffs: Sequence[int] = (10, 50)) -> DataFrame:
    """(profile, id_query, relevant, ndcg_at_k, recall_at_k) of ranks (profile, id_query, id, rank) by relevance (id_query, id, relevant).

    The ideal uses all relevant pairs of a query, whether or not the profile found them; queries without any are left out.
    """
    total = relevance.groupBy("id_query").agg(F.count_if("relevant").alias("relevant")).filter("relevant > 0")
    x = ranks.join(relevance, ["id_query", "id"]).groupBy("profile", "id_query")
    sums = [F.sum(M.gain(F.col("relevant"), F.col("rank"), k)).alias(f"dcg_{k}") for k in cutoffs] + [F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"found_{k}") for k in cutoffs]
    y = x.agg(*sums).join(total, "id_query")
    out = [(F.col(f"dcg_{k}") / M.ideal_gain(F.col("relevant"), k)).alias(f"ndcg_at_{k}") for k in cutoffs] + [(F.col(f"found_{k}") / F.col("relevant")).alias(f"recall_at_{k}") for k in cutoffs]
    return y.select("profile", "id_query", "relevant", *out)


def effectiveness(ranks: DataFrame, relevance: DataFrame, cutoffs: Sequence[int] = (10, 50)) -> DataFrame:
    """Macro averages over queries for each profile."""
    names = [f"{m}_at_{k}" for m in ("ndcg", "recall") for k in cutoffs]
    return per_query(ranks, relevance, cutoffs).groupBy("profile").agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("queries_evaluated"))


def diversity(members: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Per profile: pairs, pairs of no other profile and their rate, Jaccard similarity to each profile; from (id_query, id, profile).

    A pair is one row of flags, so every count is made in a single aggregate of one row.
    """
    flags = members.groupBy("id_query", "id").agg(*[F.max((F.col("profile") == p).cast("int")).alias(f"p{i}") for i, p in enumerate(profiles)])
    f = [F.col(f"p{i}") for i in range(len(profiles))]
    rows = []
    for i, p in enumerate(profiles):
        only = (f[i] == 1) & (sum(f[1:], f[0]) == 1)
        jaccard = [M.ratio(F.count_if((f[i] == 1) & (f[j] == 1)), F.count_if((f[i] == 1) | (f[j] == 1))).alias(f"jaccard_with_{q}") for j, q in enumerate(profiles)]
        rows.append(F.struct(F.lit(p).alias("profile"), F.count_if(f[i] == 1).alias("retrieved_pairs"), F.count_if(only).alias("exclusive_pairs"), M.ratio(F.count_if(only), F.count_if(f[i] == 1)).alias("exclusive_rate"), *jaccard))
    return flags.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
