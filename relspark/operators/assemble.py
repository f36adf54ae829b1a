"""Assembly of the benchmark table, its audit, summary and round-trip verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .contracts import enforced, none_of, same_keys

KEYS = ["id_query", "id_dataset"]


def audits(humans: DataFrame, raters: int) -> DataFrame:
    """Per pair of humans (id_query, id_dataset, annotator, relevance, reason): labels by annotator, the strict majority's relevance and reason.

    The plan fails at a pair that lacks one of the raters or has one twice.
    """
    rows = humans.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.countDistinct("annotator").alias("annotators"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("annotator", F.struct("relevance", "reason"))))).alias("labels"),
        (2 * F.count_if("relevance") > raters).alias("majority_relevance"),
    )
    rows = enforced(rows, (F.col("n") == raters) & (F.col("annotators") == raters), "pairs without all annotators", *KEYS)
    most = humans.filter("reason is not null").groupBy(*KEYS, "reason").agg(F.count("*").alias("c")).groupBy(*KEYS).agg(F.max(F.struct("c", "reason")).alias("top"))
    reason = F.when(2 * F.col("top.c") > raters, F.col("top.reason"))
    return rows.join(most, KEYS, "left").select(*KEYS, F.struct("labels", "majority_relevance", reason.alias("majority_reason")).alias("human_audit"))


def assembled(pool: DataFrame, annotations: DataFrame, default_judge: str, audit: DataFrame | None = None, judges: Sequence[str] | None = None) -> DataFrame:
    """pool (id_query, id_dataset, fields, retrieval) with annotations by judge, the default judge's relevance and the audit of sampled pairs.

    The plan fails if pairs repeat, judges differ from those configured, or the default judge has no valid judgment of a
    pair. The checks are part of it, so inputs are read once, and the count of a pair's rows shares the join's shuffle.
    """
    pool = enforced(pool.withColumn("_rows", F.count("*").over(Window.partitionBy(*KEYS))), F.col("_rows") == 1, "duplicates of a pair", *KEYS).drop("_rows")
    own = annotations.groupBy(*KEYS).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("judge", F.struct("reason", "relevance", "error"))))).alias("annotations"),
        F.max(F.when(F.col("judge") == default_judge, F.col("relevance"))).alias("default_relevance"),
    )
    out = pool.join(own, KEYS, "left").withColumn("default_relevance_source", F.lit(default_judge))
    out = enforced(out, F.col("default_relevance").isNotNull(), "no valid default judgment", *KEYS)
    if judges is not None:
        names = F.array_sort(F.array(*[F.lit(j) for j in judges]))
        out = enforced(out, F.array_sort(F.map_keys("annotations")) == names, "unexpected judges", *KEYS)
    return out if audit is None else out.join(audit, KEYS, "left")


def release_summary(benchmark: DataFrame) -> DataFrame:
    """One row: pairs, queries, default labels by value, audited pairs and those with a relevant majority."""
    audited = F.col("human_audit").isNotNull()
    return benchmark.agg(
        F.count("*").alias("pairs"),
        F.countDistinct("id_query").alias("queries"),
        F.count_if("default_relevance").alias("relevant"),
        F.count_if(~F.col("default_relevance")).alias("non_relevant"),
        F.count_if(F.col("default_relevance").isNull()).alias("missing"),
        F.count_if(audited).alias("audited"),
        F.count_if(audited & F.col("human_audit.majority_relevance")).alias("audit_relevant"),
    )


def round_trip(source: DataFrame, read_back: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that are on one side only or whose columns differ, with what; empty when the benchmark was published whole."""
    as_text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    a, b = source.select(*KEYS, as_text.alias("a")), read_back.select(*KEYS, as_text.alias("b"))
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, KEYS, "full_outer").select(*KEYS, what.alias("difference")).filter("difference is not null")


def verified(source: DataFrame, read_back: DataFrame, columns: Sequence[str]) -> None:
    same_keys(source, read_back, KEYS)
    none_of(round_trip(source, read_back, columns), "the published benchmark differs")
