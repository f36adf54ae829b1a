"""Agreement of raters: kappas, confusion metrics, reasons, false negatives, and paired bootstrap intervals.

Labels are in long form: (item, rater, label) with a boolean label, or (item, rater, reason).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M


def columns_of(labels: DataFrame, raters: Sequence[str]) -> DataFrame:
    """One row for each item with a boolean column r0, r1 ... for each rater, null where there is none."""
    return labels.groupBy("item").agg(*[F.max(F.when(F.col("rater") == r, F.col("label"))).alias(f"r{i}") for i, r in enumerate(raters)])


def pairwise_kappa(labels: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Per two raters: n items that both labelled, observed agreement, Cohen's kappa. One pass whatever the number of raters."""
    w, out = columns_of(labels, raters), []
    for i, j in combinations(range(len(raters)), 2):
        a, b = F.col(f"r{i}"), F.col(f"r{j}")
        both = a.isNotNull() & b.isNotNull()
        out.append(F.struct(F.lit(raters[i]).alias("rater_a"), F.lit(raters[j]).alias("rater_b"), F.count_if(both).alias("n"), F.count_if(both & a).alias("pa"), F.count_if(both & b).alias("pb"), F.count_if(a & b).alias("pab")))
    rows = w.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    c = [F.col(x) for x in ("n", "pa", "pb", "pab")]
    return rows.select("rater_a", "rater_b", "n", M.observed_agreement(*c).alias("observed_agreement"), M.cohen_kappa(*c).alias("cohen_kappa"))


def fleiss_kappa(ratings: DataFrame, raters: int, category: str) -> DataFrame:
    """items, mean_agreement, chance, fleiss_kappa over the items that have a category from all raters."""
    full = ratings.filter(F.col(category).isNotNull()).groupBy("item", category).agg(F.count("*").alias("c"))
    items = full.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s")).filter(F.col("n") == raters)
    point = items.agg(F.count("*").alias("items"), F.avg((F.col("s") - raters) / (raters * (raters - 1))).alias("mean_agreement"))
    share = full.join(items.select("item"), "item", "left_semi").groupBy(category).agg(F.sum("c").alias("t"))
    chance = share.agg((F.sum(F.col("t") * F.col("t")).cast("double") / F.pow(F.sum("t"), F.lit(2))).alias("chance"))
    return point.crossJoin(F.broadcast(chance)).withColumn("fleiss_kappa", M.kappa_of(F.col("mean_agreement"), F.col("chance")))  # one row each


def exact_agreement(labels: DataFrame, raters: int) -> DataFrame:
    """items, unanimous and exact_agreement; items that lack a label count as not unanimous."""
    per = labels.groupBy("item").agg(F.count("label").alias("n"), F.count_if("label").alias("p"))
    same = (F.col("n") == raters) & ((F.col("p") == 0) | (F.col("p") == raters))
    out = per.agg(F.count("*").alias("items"), F.count_if(same).alias("unanimous"))
    return out.withColumn("exact_agreement", M.ratio(F.col("unanimous"), F.col("items")))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per source of predicted (item, source, label) against truth (item, label): n, tp, tn, fp, fn, accuracy, kappa, precision, recall, f1."""
    both = predicted.select("item", "source", "label").join(truth.select("item", F.col("label").alias("truth")), "item").filter("label is not null and truth is not null")
    p, t = F.col("label"), F.col("truth")
    out = both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return out.select("*", *confusion_metrics())


def confusion_metrics() -> list:
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    return [M.ratio(tp + tn, n).alias("accuracy"), M.cohen_kappa(n, tp + fp, tp + fn, tp).alias("kappa"), M.precision(tp, fp).alias("precision"), M.recall(tp, fn).alias("recall"), M.f1(tp, fp, fn).alias("f1")]


def mean_kappa(predicted: DataFrame, humans: DataFrame) -> DataFrame:
    """Per source: mean Cohen's kappa against every human; null if one of them is."""
    both = predicted.select("item", "source", "label").join(humans.select("item", "rater", F.col("label").alias("truth")), "item").filter("label is not null and truth is not null")
    p, t = F.col("label"), F.col("truth")
    per = both.groupBy("source", "rater").agg(F.count("*").alias("n"), F.count_if(p).alias("pa"), F.count_if(t).alias("pb"), F.count_if(p & t).alias("pab"))
    k = per.withColumn("kappa", M.cohen_kappa(*[F.col(x) for x in ("n", "pa", "pb", "pab")]))
    return k.groupBy("source").agg(F.count("*").alias("humans"), F.when(F.count("kappa") == F.count("*"), F.avg("kappa")).alias("mean_kappa"))


def kappas_by_rater(predicted: DataFrame, humans: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Per source: kappa_<rater> against every rater, and mean_kappa, null if one of them is. Raters are columns, so all
    kappas are one aggregate."""
    counts = _source_counts(predicted.join(columns_of(humans, raters), "item"), len(raters), F.lit(1), ["source"])
    return counts.select("source", *_source_kappas(raters))


def _source_counts(x: DataFrame, raters: int, w: Column, keys: Sequence[str]) -> DataFrame:
    """Weighted n, pa, pb and pab of label against each of r0, r1 ..."""
    s = lambda c: F.sum(F.when(c, w).otherwise(0))
    p, out = F.col("label"), []
    for i in range(raters):
        t = F.col(f"r{i}")
        both = p.isNotNull() & t.isNotNull()
        out += [s(both).alias(f"n{i}"), s(both & p).alias(f"pa{i}"), s(both & t).alias(f"pb{i}"), s(p & t).alias(f"pab{i}")]
    return x.groupBy(*keys).agg(*out)


def _source_kappas(raters: Sequence[str]) -> list[Column]:
    k = [M.cohen_kappa(*[F.col(f"{c}{i}") for c in ("n", "pa", "pb", "pab")]) for i in range(len(raters))]
    mean = sum(k[1:], k[0]) / len(k)  # null if one is
    return [*[x.alias(f"kappa_{r}") for x, r in zip(k, raters, strict=True)], mean.alias("mean_kappa")]


def best_source(scores: DataFrame) -> DataFrame:
    """The source with the greatest mean kappa; the least name of equal ones."""
    return scores.filter("mean_kappa is not null").orderBy(F.desc("mean_kappa"), "source").limit(1)


def reason_analysis(reasons: DataFrame, raters: int, relevance: dict[str, bool]) -> DataFrame:
    """One row over (item, rater, reason): items, unanimous reasons and their rate, majority defined and undefined,
    reasons that differ with equal relevance, and items with both direct_match and subtype."""
    kinds = F.collect_set("reason")
    positive = [r for r, v in relevance.items() if v]
    per = reasons.groupBy("item").agg(kinds.alias("kinds"), F.count("reason").alias("n"), F.count_if(F.col("reason").isin(*positive)).alias("p"))
    most = reasons.filter("reason is not null").groupBy("item", "reason").agg(F.count("*").alias("c")).groupBy("item").agg(F.max("c").alias("most"))
    x = per.join(most, "item", "left")
    same = F.size("kinds") == 1
    out = x.agg(
        F.count("*").alias("pairs"),
        F.count_if(same).alias("unanimous_reason_pairs"),
        F.count_if(2 * F.col("most") > raters).alias("majority_reason_defined"),
        F.count_if(~same & ((F.col("p") == 0) | (F.col("p") == F.col("n")))).alias("non_unanimous_reason_but_unanimous_binary"),
        F.count_if(F.array_contains("kinds", "direct_match") & F.array_contains("kinds", "subtype")).alias("direct_match_subtype_disagreement_pairs"),
    )
    return out.withColumn("majority_reason_undefined", F.col("pairs") - F.col("majority_reason_defined")).withColumn("unanimous_reason_rate", M.ratio(F.col("unanimous_reason_pairs"), F.col("pairs")))


def false_negatives(predicted: DataFrame, truth: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Per source of predicted (item, source, label, reason) against truth (item, label, reason): positives it missed, how
    many have a majority reason, and among those counts by that reason and by the source's own."""
    t = truth.select("item", F.col("label").alias("truth"), F.col("reason").alias("why"))
    x = predicted.select("item", "source", "label", "reason").join(t, "item")
    miss = ~F.col("label") & F.col("truth")
    known = miss & F.col("why").isNotNull()
    out = x.groupBy("source").agg(
        F.count_if(miss).alias("false_negatives_total"),
        F.count_if(known).alias("false_negatives_with_majority_reason"),
        *[F.count_if(known & (F.col("why") == r)).alias(f"human_majority_{r}") for r in reasons],
        *[F.count_if(known & (F.col("reason") == r)).alias(f"model_reason_{r}") for r in reasons],
    )
    return out.withColumn("generic_rate", M.zero_ratio(F.col("model_reason_generic"), F.col("false_negatives_with_majority_reason")))


def resamples(spark: SparkSession, items: int, iterations: int, seed: int) -> DataFrame:
    """(iteration, pos, w): how often each of `items` positions is drawn in each resample, all from one seeded stream.

    The stream is serial by its nature; its size depends on the audited sample, not on the corpus, and multiplicities
    leave the driver in chunks.
    """
    draw, parts = random.Random(seed), []
    for it in range(iterations):
        counts: dict[int, int] = {}
        for _ in range(items):
            p = draw.randrange(items)
            counts[p] = counts.get(p, 0) + 1
        parts.append(pd.DataFrame({"iteration": it, "pos": list(counts), "w": list(counts.values())}))
    return spark.createDataFrame(pd.concat(parts) if parts else pd.DataFrame({"iteration": [], "pos": [], "w": []}), "iteration int, pos int, w int")


@dataclass(frozen=True)
class Weights:
    """Weights of resamples by a rule: items has a row with the key of each item that is drawn from, of(iteration, key) is
    its weight. They are made where they are summed, so no row of an item and iteration is sorted or shuffled; a table of
    weights has such rows and is for audited samples."""

    items: DataFrame
    iterations: int
    of: Callable[[Column, Column], Column]


def _weighted(x: DataFrame, weights: DataFrame | Weights, key: str, by: Sequence[str]) -> DataFrame:
    """(iteration, by, w): summed weights of the rows of x by iteration and combination of the few values of by, each added
    up in the task that has the rows."""
    if isinstance(weights, Weights):
        drawn = weights.items.groupBy(key).agg(F.count("*").alias("times"))
        rows = x.select(key, *by).join(drawn, key).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(weights.iterations - 1))))
        rows = rows.withColumn("w", F.col("times") * weights.of(F.col("iteration"), F.col(key)))
    else:
        rows = x.select(key, *by).join(weights, key)
    return rows.groupBy("iteration", *by).agg(F.sum("w").alias("w"))


def bootstrap_intervals(confusions: DataFrame, weights: DataFrame | Weights, confidence: float = 0.95) -> DataFrame:
    """Per source: percentile intervals of kappa, precision, recall and f1.

    confusions is (pos, source, label, truth); weights (iteration, pos, w) or by a rule is shared by all sources and
    metrics, which are all made from one aggregate.
    """
    p, t, w = F.col("label"), F.col("truth"), F.col("w")
    x = _weighted(confusions.filter("label is not null and truth is not null"), weights, "pos", ["source", "label", "truth"])
    s = lambda c, name: F.sum(F.when(c, w).otherwise(0)).alias(name)
    per = x.groupBy("source", "iteration").agg(s(p & t, "tp"), s(~p & ~t, "tn"), s(p & ~t, "fp"), s(~p & t, "fn")).select("source", *confusion_metrics())
    tail = (1 - confidence) / 2
    names = ("kappa", "precision", "recall", "f1")
    bounds = [F.percentile(m, q).alias(f"{m}_ci_{e}") for m in names for q, e in ((tail, "low"), (1 - tail, "high"))]
    return per.groupBy("source").agg(F.count("*").alias("iterations"), *bounds)


def _bounds(values: DataFrame, keys: Sequence[str], names: Sequence[str], confidence: float) -> DataFrame:
    """Percentile intervals over the rows of each of keys, as <name>_ci_low and <name>_ci_high."""
    tail = (1 - confidence) / 2
    ends = [F.percentile(F.col(m), q).alias(f"{m}_ci_{e}") for m in names for q, e in ((tail, "low"), (1 - tail, "high"))]
    return values.groupBy(*keys).agg(F.count("*").alias("iterations"), *ends)


def human_intervals(labels: DataFrame, raters: Sequence[str], weights: DataFrame | Weights, confidence: float = 0.95) -> DataFrame:
    """One row: percentile intervals of each two raters' kappa, of Fleiss' kappa and of exact agreement.

    weights is (iteration, item, w) or by a rule, shared by all metrics, which come from one aggregate by iteration.
    """
    w, k = F.col("w"), len(raters)
    x = _weighted(columns_of(labels, raters), weights, "item", [f"r{i}" for i in range(k)])
    r = [F.col(f"r{i}") for i in range(k)]
    s = lambda c, v=w: F.sum(F.when(c, v).otherwise(0))
    full, p = r[0].isNotNull(), r[0].cast("int")
    for c in r[1:]:
        full, p = full & c.isNotNull(), p + c.cast("int")
    sums = [s(full).alias("n"), s(full, w * (p * p + (k - p) * (k - p) - k) / (k * (k - 1))).alias("same"), s(full, w * p).alias("positive"), s(full & ((p == 0) | (p == k))).alias("unanimous"), F.sum("w").alias("all")]
    for i, j in combinations(range(k), 2):
        both = r[i].isNotNull() & r[j].isNotNull()
        sums += [s(both).alias(f"n_{i}_{j}"), s(both & r[i]).alias(f"pa_{i}_{j}"), s(both & r[j]).alias(f"pb_{i}_{j}"), s(r[i] & r[j]).alias(f"pab_{i}_{j}")]
    share = M.ratio(F.col("positive"), F.col("n") * k)
    out = {f"cohen_kappa_{raters[i]}_{raters[j]}": M.cohen_kappa(*[F.col(f"{c}_{i}_{j}") for c in ("n", "pa", "pb", "pab")]) for i, j in combinations(range(k), 2)}
    out |= {"fleiss_kappa": M.kappa_of(M.ratio(F.col("same"), F.col("n")), share * share + (1 - share) * (1 - share)), "exact_agreement": M.ratio(F.col("unanimous"), F.col("all"))}
    return _bounds(x.groupBy("iteration").agg(*sums).select(*[v.alias(n) for n, v in out.items()]), [], list(out), confidence)


def rater_intervals(predicted: DataFrame, humans: DataFrame, raters: Sequence[str], weights: DataFrame | Weights, confidence: float = 0.95) -> DataFrame:
    """Per source: percentile intervals of its kappa against each rater and of their mean."""
    x = _weighted(predicted.join(columns_of(humans, raters), "item"), weights, "item", ["source", "label", *[f"r{i}" for i in range(len(raters))]])
    per = _source_counts(x, len(raters), F.col("w"), ["source", "iteration"]).select("source", *_source_kappas(raters))
    return _bounds(per, ["source"], [*[f"kappa_{r}" for r in raters], "mean_kappa"], confidence)


def reason_intervals(reasons: DataFrame, raters: int, categories: Sequence[str], weights: DataFrame | Weights, confidence: float = 0.95) -> DataFrame:
    """One row: percentile intervals of Fleiss' kappa over reasons and of the rate of unanimous ones."""
    per = reasons.groupBy("item").agg(*[F.count_if(F.col("reason") == c).alias(f"c{i}") for i, c in enumerate(categories)])
    c, w = [F.col(f"c{i}") for i in range(len(categories))], F.col("w")
    total, squares = sum(c[1:], c[0]), sum((x * x for x in c[1:]), c[0] * c[0])
    x = _weighted(per, weights, "item", [f"c{i}" for i in range(len(categories))])
    x = x.withColumn("full", total == raters).withColumn("same", (squares - raters) / (raters * (raters - 1)))
    s = lambda v: F.sum(F.when(F.col("full"), v).otherwise(0))
    sums = x.groupBy("iteration").agg(s(w).alias("n"), s(w * F.col("same")).alias("same"), s(F.when(F.col("same") == 1, w).otherwise(0)).alias("unanimous"), F.sum("w").alias("all"), *[s(w * k).alias(f"t{i}") for i, k in enumerate(c)])
    share = [M.ratio(F.col(f"t{i}"), F.col("n") * raters) for i in range(len(c))]
    chance = sum((x * x for x in share[1:]), share[0] * share[0])
    values = sums.select(M.kappa_of(M.ratio(F.col("same"), F.col("n")), chance).alias("fleiss_kappa"), M.ratio(F.col("unanimous"), F.col("all")).alias("unanimous_rate"))
    return _bounds(values, [], ["fleiss_kappa", "unanimous_rate"], confidence)


def human_report(labels: DataFrame, raters: Sequence[str]) -> DataFrame:
    """pairwise_kappa with Fleiss' kappa and exact agreement on every row."""
    one = fleiss_kappa(labels, len(raters), "label").select("fleiss_kappa").crossJoin(F.broadcast(exact_agreement(labels, len(raters)).select("exact_agreement")))  # one row each
    return pairwise_kappa(labels, raters).crossJoin(F.broadcast(one))
