"""Judgments to relevance, panels of three judges, majorities and their summaries.

Votes are in long form: (id_query, id_dataset, judge, relevance), relevance null where a judgment is invalid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RELEVANCE

KEYS = ["id_query", "id_dataset"]


def relevance_of(reason: Column, error: Column | None = None, relevance: Mapping[str, bool] = RELEVANCE) -> Column:
    """The relevance that a reason stands for; null for unknown reasons and for judgments with an error."""
    known = F.create_map(*[F.lit(x) for kv in relevance.items() for x in kv])
    found = F.element_at(known, F.trim(F.coalesce(reason, F.lit(""))))
    return found if error is None else F.when(error.isNull(), found)


def contradiction(reason: Column, stored: Column, relevance: Mapping[str, bool] = RELEVANCE) -> Column:
    """Whether a stored relevance differs from that of its reason."""
    return F.coalesce(stored != relevance_of(reason, None, relevance), F.lit(False))


def strict_majority(a: Column, b: Column, c: Column) -> Column:
    """Two of three; null if any is missing."""
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), a.cast("int") + b.cast("int") + c.cast("int") >= 2)


def wide(votes: DataFrame, judges: Sequence[str], value: str = "relevance") -> DataFrame:
    """One row for each pair with a column v0, v1 ... for each judge: one shuffle, in place of a join for each judge."""
    return votes.groupBy(*KEYS).agg(*[F.max(F.when(F.col("judge") == j, F.col(value))).alias(f"v{i}") for i, j in enumerate(judges)])


def panels(votes: DataFrame, judges: Sequence[str]) -> DataFrame:
    """A row for each pair and panel of three judges in the given order, with their votes, valid_votes and aggregated_relevance.

    Panels are unrolled from one row by explode, so nothing is joined.
    """
    rows = []
    for n, (i, j, k) in enumerate(combinations(range(len(judges)), 3)):
        v = [F.col(f"v{x}") for x in (i, j, k)]
        valid = sum((x.isNotNull().cast("int") for x in v[1:]), v[0].isNotNull().cast("int"))
        names = [judges[x] for x in (i, j, k)]
        parts = [F.lit(n).alias("panel_order"), F.lit(" + ".join(names)).alias("combination"), *[F.lit(x).alias(f"judge_{y + 1}") for y, x in enumerate(names)]]
        parts += [x.alias(f"judge_{y + 1}_relevance") for y, x in enumerate(v)]
        rows.append(F.struct(*parts, valid.alias("valid_votes"), strict_majority(*v).alias("aggregated_relevance")))
    return wide(votes, judges).select(*KEYS, F.explode(F.array(*rows)).alias("p")).select(*KEYS, "p.*")


def panel_summary(rows: DataFrame) -> DataFrame:
    """Per combination: pairs, valid, missing, positive, negative, positive_rate (of valid ones, null without any)."""
    value = F.col("aggregated_relevance")
    out = rows.groupBy("combination").agg(F.count("*").alias("pairs"), F.count(value).alias("valid"), F.count_if(value).alias("positive"))
    return out.select("combination", "pairs", "valid", (F.col("pairs") - F.col("valid")).alias("missing"), "positive", (F.col("valid") - F.col("positive")).alias("negative"), F.try_divide(F.col("positive").cast("double"), F.col("valid")).alias("positive_rate"))


def available_majority(votes: DataFrame) -> DataFrame:
    """Per pair: votes for and against among those there are, and the majority; null for ties and without votes."""
    out = votes.groupBy(*KEYS).agg(F.count_if("relevance").alias("votes_for"), F.count_if(~F.col("relevance")).alias("votes_against"))
    return out.withColumn("majority", F.when(F.col("votes_for") > F.col("votes_against"), True).when(F.col("votes_for") < F.col("votes_against"), False))


def reason_majority(votes: DataFrame) -> DataFrame:
    """Per pair: raters, and the reason that more than half of them gave; null otherwise. Missing reasons stay in the denominator."""
    counts = votes.groupBy(*KEYS, "reason").agg(F.count("*").alias("n"))
    out = counts.groupBy(*KEYS).agg(F.sum("n").alias("raters"), F.max(F.when(F.col("reason").isNotNull(), F.struct("n", "reason"))).alias("top"))
    return out.select(*KEYS, "raters", F.when(2 * F.col("top.n") > F.col("raters"), F.col("top.reason")).alias("majority_reason"))


def label_distribution(votes: DataFrame) -> DataFrame:
    """Per judge: positive, negative, invalid, valid, positive_label_rate and valid_output_rate."""
    v = F.col("relevance")
    out = votes.groupBy("judge").agg(F.count_if(v).alias("positive"), F.count_if(~v).alias("negative"), F.count_if(v.isNull()).alias("invalid"), F.count(v).alias("valid"), F.count("*").alias("total"))
    return out.withColumn("positive_label_rate", F.try_divide(F.col("positive").cast("double"), F.col("valid"))).withColumn("valid_output_rate", F.try_divide(F.col("valid").cast("double"), F.col("total"))).drop("total")


def distribution(votes: DataFrame, column: str, values: Sequence[str], total: Column, name: str) -> DataFrame:
    """Per judge: `name` (rows where total holds), then a count and a rate for each of values, zero ones included."""
    out = votes.groupBy("judge").agg(F.count_if(total).alias(name), *[F.count_if(total & (F.col(column) == v)).alias(f"{v}_count") for v in values])
    return out.select("*", *[F.try_divide(F.col(f"{v}_count").cast("double"), F.col(name)).alias(f"{v}_rate") for v in values])


def with_display_names(rows: DataFrame, names: Mapping[str, str], column: str = "judge") -> DataFrame:
    """rows with display_name: the name of the judge, or its id where there is none."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return rows.withColumn("display_name", F.coalesce(F.element_at(known, F.col(column)), F.col(column)) if names else F.col(column))
