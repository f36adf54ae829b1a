"""Checks of tables. Each looks for a few offending rows and raises with them; none collects a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ContractError

EXAMPLES = 10


def none_of(bad: DataFrame, message: str) -> None:
    found = bad.limit(EXAMPLES).collect()
    if found:
        raise ContractError(f"{message}: {[r.asDict() for r in found]}")


def all_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    none_of(df.filter(~F.coalesce(condition, F.lit(False))), message)
    return df


def enforced(df: DataFrame, condition: Column, message: str, *shown: str) -> DataFrame:
    """df, whose plan itself fails at a row without the condition; nothing runs before the result is read."""
    what = F.concat(F.lit(f"{message}: "), F.to_json(F.struct(*shown)))
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(what).cast("boolean")))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    none_of(df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1"), f"duplicates of {keys}")
    return df


def not_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(message)
    return df


def covered(a: DataFrame, b: DataFrame, keys: Sequence[str], message: str = "missing") -> None:
    """Every key of a is in b."""
    none_of(a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti"), message)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    covered(a, b, keys, "missing")
    covered(b, a, keys, "unexpected")


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-outer coverage: the keys of one side only, with side 'missing' (from b) or 'extra'."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
    return x.join(y, list(keys), "full_outer").select(*keys, side.alias("side")).filter("side is not null")


def contiguous_ranks(df: DataFrame, groups: Sequence[str], rank: str = "rank", strict: bool = True) -> DataFrame:
    """Per group: rows, distinct ranks, least and most rank, and whether ranks are unique and, if strict, 1 to n."""
    out = df.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct(rank).alias("n_ranks"), F.min(rank).cast("long").alias("first_rank"), F.max(rank).cast("long").alias("last_rank"))
    ok = (F.col("n") == F.col("n_ranks")) & (F.col("first_rank") >= 1)
    return out.withColumn("ok", ok & (F.col("first_rank") == 1) & (F.col("last_rank") == F.col("n")) if strict else ok)


def valid_provenance(retrieval: Column) -> Column:
    """A non-empty map of struct<rank, score> with positive ranks and finite scores."""
    fine = lambda x: (x["rank"] > 0) & ~F.isnan(x["score"].cast("double")) & (F.abs(x["score"].cast("double")) < float("inf"))
    return (F.size(retrieval) > 0) & F.forall(F.map_values(retrieval), fine)


def checked_queries(df: DataFrame) -> DataFrame:
    """(id_query, query) of a query table with ID and QUERY: ids positive decimals and unique, texts not blank, at least one row."""
    missing = {"ID", "QUERY"} - set(df.columns)
    if missing:
        raise ContractError(f"the query table lacks {sorted(missing)}")
    not_empty(df, "the query table is empty")
    all_rows(df, F.trim("ID").rlike("^0*[1-9][0-9]*$"), "ids must be positive integers")
    all_rows(df, F.trim("QUERY") != "", "queries must not be blank")
    return unique(df.select(F.trim("ID").cast("int").alias("id_query"), F.trim("QUERY").alias("query")), "id_query")


def checked_hits(hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Hits with all text fields, an id that isn't blank and a finite score, each id once for a query."""
    missing = set(fields) - set(hits.columns)
    if missing:
        raise ContractError(f"hits lack {sorted(missing)}")
    score = F.col("score").cast("double")
    fine = (F.trim("id") != "") & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    for f in fields:
        fine = fine & F.col(f).isNotNull()
    return unique(all_rows(hits, fine, "hits that break the contract"), "id_query", "id")


def order_differences(a: DataFrame, b: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """Groups whose items differ between two tables or stand in another order."""
    ids = lambda df, name: df.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i")))), lambda x: x["i"]).alias(name))
    both = ids(a, "a").join(ids(b, "b"), group, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(group, F.coalesce(F.size("a"), F.lit(0)).alias("n_a"), F.coalesce(F.size("b"), F.lit(0)).alias("n_b"))


def used_at_least_once(votes: DataFrame, judges: DataFrame) -> None:
    """Every configured judge (judge) has a vote."""
    covered(judges, votes, ["judge"], "judges without any vote")
