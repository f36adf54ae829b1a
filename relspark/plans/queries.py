"""The engine's operators over the test tables, and the same in SQL.

Roles: documents are datasets (title: first line, description: text), benchmark items are queries, labels are one real
annotator, and judges are arithmetic in doc_id, so that SQL makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVIDENCE_FIELDS, RELEVANCE
from ..functions import text as T
from ..operators import agreement, assemble, collection, contracts, ireval, judge, retrieval, sampling, votes
from ..sources.readers import spread

JUDGES = ["judge_a", "judge_b", "judge_c", "judge_d", "judge_e"]
HUMANS = ["h1", "h2", "h3"]
PROFILES = ["lexical", "dense_a", "dense_b"]
REASONS = list(RELEVANCE)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def reason_at(r: Column) -> Column:
    """Reasons by a number: 0-2, 3-4, 5-6, 7-8, 9; others are invalid."""
    return F.when(r <= 2, REASONS[0]).when(r <= 4, REASONS[1]).when(r <= 6, REASONS[2]).when(r <= 8, REASONS[3]).when(r == 9, REASONS[4])


def pairs_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("id_query"), F.concat(F.lit("d"), F.col("doc_id")).alias("id_dataset"), "doc_id")


def votes_of(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("doc_id"), F.col("k")
    numbered = pairs_of(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    r = (F.floor(d / 3) + k * 3 + (d % 7) * (k % 2)) % 11
    reason = reason_at(r)
    fields = F.array(*[F.lit(f) for f in EVIDENCE_FIELDS])
    out = numbered.withColumn("reason", reason).withColumn("relevance", votes.relevance_of(F.col("reason")))
    return out.select("id_query", "id_dataset", "doc_id", F.get(F.array(*[F.lit(j) for j in JUDGES]), k).alias("judge"), "reason", "relevance", F.when(F.col("relevance"), F.get(fields, ((d + k) % 4).cast("int"))).alias("supporting_field"))


def humans_of(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("doc_id"), F.col("k")
    numbered = pairs_of(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    reason = reason_at((F.floor(d / 3) + k * 2 * F.when(d % 5 == 0, 1).otherwise(0)) % 10)
    return numbered.select("id_query", "id_dataset", "doc_id", F.get(F.array(*[F.lit(j) for j in HUMANS]), k).alias("annotator"), reason.alias("reason")).withColumn("relevance", votes.relevance_of(F.col("reason")))


BASE = """
pairs AS (SELECT doc_id % 20 AS id_query, 'd' || doc_id AS id_dataset, doc_id FROM documents),
numbered AS (SELECT pairs.*, k, (doc_id // 3 + k * 3 + (doc_id % 7) * (k % 2)) % 11 AS r FROM pairs, range(5) t(k)),
reasoned AS (SELECT *, CASE WHEN r <= 2 THEN 'direct_match' WHEN r <= 4 THEN 'subtype' WHEN r <= 6 THEN 'generic' WHEN r <= 8 THEN 'unrelated' WHEN r = 9 THEN 'insufficient_evidence' END AS reason FROM numbered),
v AS (SELECT id_query, id_dataset, doc_id, k, 'judge_' || chr(CAST(97 + k AS INTEGER)) AS judge, reason,
  CASE WHEN reason IN ('direct_match', 'subtype') THEN true WHEN reason IS NOT NULL THEN false END AS relevance,
  CASE WHEN reason IN ('direct_match', 'subtype') THEN ['title', 'description', 'header', 'content'][(doc_id + k) % 4 + 1] END AS supporting_field FROM reasoned),
hn AS (SELECT pairs.*, k, (doc_id // 3 + k * 2 * (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)) % 10 AS r FROM pairs, range(3) t(k)),
hr AS (SELECT *, CASE WHEN r <= 2 THEN 'direct_match' WHEN r <= 4 THEN 'subtype' WHEN r <= 6 THEN 'generic' WHEN r <= 8 THEN 'unrelated' WHEN r = 9 THEN 'insufficient_evidence' END AS reason FROM hn),
h AS (SELECT id_query, id_dataset, doc_id, 'h' || (k + 1) AS annotator, reason, reason IN ('direct_match', 'subtype') AS relevance FROM hr)
"""
PANELS = """
w AS (SELECT id_query, id_dataset, max(CASE WHEN k = 0 THEN relevance END) AS v0, max(CASE WHEN k = 1 THEN relevance END) AS v1, max(CASE WHEN k = 2 THEN relevance END) AS v2, max(CASE WHEN k = 3 THEN relevance END) AS v3, max(CASE WHEN k = 4 THEN relevance END) AS v4 FROM v GROUP BY ALL),
j AS (SELECT * FROM (VALUES (0, 'judge_a'), (1, 'judge_b'), (2, 'judge_c'), (3, 'judge_d'), (4, 'judge_e')) t(i, name)),
combos AS (SELECT a.i AS i, b.i AS j, c.i AS k, a.name AS ja, b.name AS jb, c.name AS jc FROM j a, j b, j c WHERE a.i < b.i AND b.i < c.i),
p0 AS (SELECT id_query, id_dataset, ja || ' + ' || jb || ' + ' || jc AS combination, ja AS judge_1, jb AS judge_2, jc AS judge_3,
  [v0, v1, v2, v3, v4][i + 1] AS judge_1_relevance, [v0, v1, v2, v3, v4][j + 1] AS judge_2_relevance, [v0, v1, v2, v3, v4][k + 1] AS judge_3_relevance FROM w, combos),
p AS (SELECT *, CAST((judge_1_relevance IS NOT NULL)::INT + (judge_2_relevance IS NOT NULL)::INT + (judge_3_relevance IS NOT NULL)::INT AS INTEGER) AS valid_votes,
  CASE WHEN judge_1_relevance IS NOT NULL AND judge_2_relevance IS NOT NULL AND judge_3_relevance IS NOT NULL THEN judge_1_relevance::INT + judge_2_relevance::INT + judge_3_relevance::INT >= 2 END AS aggregated_relevance FROM p0)
"""
KAPPA = "CASE WHEN po IS NULL THEN NULL WHEN 1 - pe = 0 THEN CASE WHEN abs(po - 1) <= 1e-9 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END"


def with_base(body: str, *more: str) -> str:
    return "WITH " + ",".join([BASE, *more]) + body


@query(with_base("""
SELECT judge, count(*) FILTER (relevance) AS positive, count(*) FILTER (NOT relevance) AS negative, count(*) FILTER (relevance IS NULL) AS invalid, count(relevance) AS valid,
  round(count(*) FILTER (relevance) / count(relevance), 6) AS positive_label_rate, round(count(relevance) / count(*), 6) AS valid_output_rate FROM v GROUP BY judge"""))
def judge_label_distribution(spark, sf):
    return rounded(votes.label_distribution(votes_of(spark, sf)))


@query(with_base("SELECT judge, count(*) FILTER (reason IS NOT NULL) AS valid, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}_count, round(count(*) FILTER (reason = '{r}') / count(reason), 6) AS {r}_rate" for r in REASONS) + " FROM v GROUP BY judge"))
def judge_reason_distribution(spark, sf):
    return rounded(votes.distribution(votes_of(spark, sf), "reason", REASONS, F.col("reason").isNotNull(), "valid"))


@query(with_base("SELECT judge, count(*) FILTER (relevance) AS positive, " + ", ".join(f"count(*) FILTER (supporting_field = '{r}') AS {r}_count, round(count(*) FILTER (supporting_field = '{r}') / count(*) FILTER (relevance), 6) AS {r}_rate" for r in EVIDENCE_FIELDS) + " FROM v GROUP BY judge"))
def supporting_field_distribution(spark, sf):
    return rounded(votes.distribution(votes_of(spark, sf), "supporting_field", EVIDENCE_FIELDS, F.coalesce(F.col("relevance"), F.lit(False)), "positive"))


@query(with_base("SELECT id_query, id_dataset, combination, judge_1, judge_2, judge_3, judge_1_relevance, judge_2_relevance, judge_3_relevance, valid_votes, aggregated_relevance FROM p", PANELS))
def three_judge_aggregation(spark, sf):
    return votes.panels(votes_of(spark, sf), JUDGES).drop("panel_order")


@query(with_base("""
SELECT combination, count(*) AS pairs, count(aggregated_relevance) AS valid, count(*) - count(aggregated_relevance) AS missing, count(*) FILTER (aggregated_relevance) AS positive,
  count(*) FILTER (NOT aggregated_relevance) AS negative, round(count(*) FILTER (aggregated_relevance) / count(aggregated_relevance), 6) AS positive_rate FROM p GROUP BY combination""", PANELS))
def three_judge_summary(spark, sf):
    return rounded(votes.panel_summary(votes.panels(votes_of(spark, sf), JUDGES)))


@query(with_base("""
SELECT id_query, id_dataset, count(*) FILTER (relevance) AS votes_for, count(*) FILTER (NOT relevance) AS votes_against,
  CASE WHEN count(*) FILTER (relevance) > count(*) FILTER (NOT relevance) THEN true WHEN count(*) FILTER (relevance) < count(*) FILTER (NOT relevance) THEN false END AS majority FROM v GROUP BY ALL"""))
def available_majority(spark, sf):
    return votes.available_majority(votes_of(spark, sf))


@query(with_base("""
SELECT id_query, id_dataset, n AS raters, CASE WHEN 2 * c > n THEN top END AS majority_reason FROM (
  SELECT id_query, id_dataset, sum(c)::BIGINT AS n, max(c) FILTER (reason IS NOT NULL) AS c, arg_max(reason, c) FILTER (reason IS NOT NULL) AS top
  FROM (SELECT id_query, id_dataset, reason, count(*) AS c FROM v GROUP BY ALL) GROUP BY ALL)"""))
def reason_majority(spark, sf):
    return votes.reason_majority(votes_of(spark, sf))


def items(df: DataFrame, rater: str) -> DataFrame:
    return df.select(F.col("doc_id").alias("item"), F.col(rater).alias("rater"), F.col("relevance").alias("label"), "reason")


PAIRWISE = f"""
c AS (SELECT a.{{r}} AS rater_a, b.{{r}} AS rater_b, count(*)::DOUBLE AS n, count(*) FILTER (a.relevance)::DOUBLE AS pa, count(*) FILTER (b.relevance)::DOUBLE AS pb, count(*) FILTER (a.relevance AND b.relevance)::DOUBLE AS pab
  FROM {{t}} a JOIN {{t}} b ON a.doc_id = b.doc_id AND a.{{r}} < b.{{r}} WHERE a.relevance IS NOT NULL AND b.relevance IS NOT NULL GROUP BY ALL),
k AS (SELECT *, (n - pa - pb + 2 * pab) / n AS po, (pa * pb + (n - pa) * (n - pb)) / (n * n) AS pe FROM c),
pk AS (SELECT rater_a, rater_b, n::BIGINT AS n, round(po, 6) AS observed_agreement, round({KAPPA}, 6) AS cohen_kappa FROM k)
"""


@query(with_base("SELECT * FROM pk", PAIRWISE.format(r="judge", t="v")))
def cohen_kappa_pairwise(spark, sf):
    return rounded(agreement.pairwise_kappa(items(votes_of(spark, sf), "judge"), JUDGES))


FLEISS = f"""
f0 AS (SELECT doc_id, {{c}} AS cat, count(*) AS c FROM h WHERE {{c}} IS NOT NULL GROUP BY ALL),
f1 AS (SELECT doc_id, sum(c) AS n, sum(c * c) AS s FROM f0 GROUP BY doc_id HAVING sum(c) = 3),
f2 AS (SELECT count(*) AS items, avg((s - 3) / 6.0) AS po FROM f1),
f3 AS (SELECT sum(t * t)::DOUBLE / power(sum(t), 2) AS pe FROM (SELECT cat, sum(c) AS t FROM f0 WHERE doc_id IN (SELECT doc_id FROM f1) GROUP BY cat)),
fk AS (SELECT items, round(po, 6) AS mean_agreement, round(pe, 6) AS chance, round({KAPPA}, 6) AS fleiss_kappa FROM f2, f3)
"""


@query(with_base("SELECT * FROM fk", FLEISS.format(c="relevance")))
def fleiss_kappa_binary(spark, sf):
    return rounded(agreement.fleiss_kappa(items(humans_of(spark, sf), "annotator"), 3, "label"))


@query(with_base("SELECT * FROM fk", FLEISS.format(c="reason")))
def fleiss_kappa_reason(spark, sf):
    return rounded(agreement.fleiss_kappa(items(humans_of(spark, sf), "annotator"), 3, "reason"))


EXACT = """
e AS (SELECT count(*) AS items, count(*) FILTER (p IN (0, 3)) AS unanimous FROM (SELECT doc_id, count(*) FILTER (relevance) AS p FROM h GROUP BY doc_id))
"""


@query(with_base("SELECT items, unanimous, round(unanimous / items, 6) AS exact_agreement FROM e", EXACT))
def exact_agreement(spark, sf):
    return rounded(agreement.exact_agreement(items(humans_of(spark, sf), "annotator"), 3))


@query(with_base("SELECT pk.*, fleiss_kappa, round(unanimous / e.items, 6) AS exact_agreement FROM pk, fk, e", PAIRWISE.format(r="annotator", t="h"), FLEISS.format(c="relevance"), EXACT))
def human_agreement_report(spark, sf):
    return rounded(agreement.human_report(items(humans_of(spark, sf), "annotator"), HUMANS))


def truth_of(spark: SparkSession, sf: str) -> DataFrame:
    h = humans_of(spark, sf)
    label = votes.available_majority(h).select("id_query", "id_dataset", F.col("majority").alias("label"))
    reason = votes.reason_majority(h).select("id_query", "id_dataset", F.col("majority_reason").alias("reason"))
    return label.join(reason, ["id_query", "id_dataset"]).select(F.col("id_dataset").alias("item"), "label", "reason")


def predicted_of(spark: SparkSession, sf: str) -> DataFrame:
    return votes_of(spark, sf).select(F.col("id_dataset").alias("item"), F.col("judge").alias("source"), F.col("relevance").alias("label"), "reason")


TRUTH = """
t0 AS (SELECT id_dataset, count(*) FILTER (relevance) >= 2 AS truth FROM h GROUP BY id_dataset),
t1 AS (SELECT id_dataset, arg_max(reason, c) AS why FROM (SELECT id_dataset, reason, count(*) AS c FROM h GROUP BY ALL) WHERE c >= 2 GROUP BY id_dataset),
t AS (SELECT t0.id_dataset, truth, why FROM t0 LEFT JOIN t1 USING (id_dataset))
"""
CONFUSION = f"""
x AS (SELECT {{s}} AS source, count(*)::DOUBLE AS n, count(*) FILTER ({{l}} AND truth)::DOUBLE AS tp, count(*) FILTER (NOT {{l}} AND NOT truth)::DOUBLE AS tn, count(*) FILTER ({{l}} AND NOT truth)::DOUBLE AS fp, count(*) FILTER (NOT {{l}} AND truth)::DOUBLE AS fn
  FROM {{f}} JOIN t USING (id_dataset) WHERE {{l}} IS NOT NULL GROUP BY 1),
y AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (n - tp - fp) * (n - tp - fn)) / (n * n) AS pe FROM x),
z AS (SELECT source, n::BIGINT AS n, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round(po, 6) AS accuracy, round({KAPPA}, 6) AS kappa,
  CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM y)
"""


@query(with_base("SELECT * FROM z", TRUTH, CONFUSION.format(s="judge", l="relevance", f="v")))
def binary_metrics_vs_majority(spark, sf):
    return rounded(agreement.confusion(predicted_of(spark, sf), truth_of(spark, sf)))


@query(with_base("SELECT * FROM z", PANELS, TRUTH, CONFUSION.format(s="combination", l="aggregated_relevance", f="p")))
def panel_metrics_vs_majority(spark, sf):
    rows = votes.panels(votes_of(spark, sf), JUDGES)
    predicted = rows.select(F.col("id_dataset").alias("item"), F.col("combination").alias("source"), F.col("aggregated_relevance").alias("label"))
    return rounded(agreement.confusion(predicted, truth_of(spark, sf)))


MEAN_KAPPA = f"""
c AS (SELECT judge AS source, annotator, count(*)::DOUBLE AS n, count(*) FILTER (v.relevance)::DOUBLE AS pa, count(*) FILTER (h.relevance)::DOUBLE AS pb, count(*) FILTER (v.relevance AND h.relevance)::DOUBLE AS pab
  FROM v JOIN h USING (doc_id) WHERE v.relevance IS NOT NULL GROUP BY ALL),
k AS (SELECT *, (n - pa - pb + 2 * pab) / n AS po, (pa * pb + (n - pa) * (n - pb)) / (n * n) AS pe FROM c),
mk AS (SELECT source, count(*) AS humans, round(avg({KAPPA}), 6) AS mean_kappa FROM k GROUP BY source)
"""


def _mean_kappa(spark, sf):
    h = humans_of(spark, sf).select(F.col("id_dataset").alias("item"), F.col("annotator").alias("rater"), F.col("relevance").alias("label"))
    return rounded(agreement.mean_kappa(predicted_of(spark, sf), h))


@query(with_base("SELECT * FROM mk", MEAN_KAPPA))
def mean_pairwise_kappa(spark, sf):
    return _mean_kappa(spark, sf)


@query(with_base("SELECT * FROM mk ORDER BY mean_kappa DESC, source LIMIT 1", MEAN_KAPPA))
def best_judge(spark, sf):
    return agreement.best_source(_mean_kappa(spark, sf))


@query(with_base("""
SELECT count(*) AS pairs, count(*) FILTER (kinds = 1) AS unanimous_reason_pairs, round(count(*) FILTER (kinds = 1) / count(*), 6) AS unanimous_reason_rate,
  count(*) FILTER (2 * most > 3) AS majority_reason_defined, count(*) FILTER (2 * most <= 3) AS majority_reason_undefined,
  count(*) FILTER (kinds > 1 AND p IN (0, 3)) AS non_unanimous_reason_but_unanimous_binary, count(*) FILTER (dm AND st) AS direct_match_subtype_disagreement_pairs
FROM (SELECT doc_id, count(*) AS kinds, max(c) AS most, sum(CASE WHEN reason IN ('direct_match', 'subtype') THEN c ELSE 0 END) AS p, bool_or(reason = 'direct_match') AS dm, bool_or(reason = 'subtype') AS st
  FROM (SELECT doc_id, reason, count(*) AS c FROM h GROUP BY ALL) GROUP BY doc_id)"""))
def reason_analysis(spark, sf):
    return rounded(agreement.reason_analysis(items(humans_of(spark, sf), "annotator"), 3, RELEVANCE))


@query(with_base("SELECT judge AS source, count(*) FILTER (NOT relevance AND truth) AS false_negatives_total, count(*) FILTER (NOT relevance AND truth AND why IS NOT NULL) AS false_negatives_with_majority_reason, "
    + ", ".join(f"count(*) FILTER (NOT relevance AND truth AND why = '{r}') AS human_majority_{r}, count(*) FILTER (NOT relevance AND truth AND why IS NOT NULL AND reason = '{r}') AS model_reason_{r}" for r in REASONS)
    + ", coalesce(round(count(*) FILTER (NOT relevance AND truth AND why IS NOT NULL AND reason = 'generic') / nullif(count(*) FILTER (NOT relevance AND truth AND why IS NOT NULL), 0), 6), 0) AS generic_rate FROM v JOIN t USING (id_dataset) GROUP BY judge", TRUTH))
def false_negative_reasons(spark, sf):
    return rounded(agreement.false_negatives(predicted_of(spark, sf), truth_of(spark, sf), REASONS))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS mid, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice) GROUP BY l_returnflag")
def percentile_ci(spark, sf):
    x = table(spark, sf, "lineitem").filter("l_extendedprice is not null and not isnan(l_extendedprice)")
    return rounded(x.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p")).select("l_returnflag", *[F.col("p")[i].alias(n) for i, n in enumerate(("low", "mid", "high"))]))


@query(with_base(f"""
SELECT source, count(*) AS iterations, """ + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_ci_{e}" for m in ("kappa", "precision", "recall", "f1") for q, e in ((0.025, "low"), (0.975, "high"))) + f""" FROM (
  SELECT source, it, {KAPPA} AS kappa, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (n - tp - fp) * (n - tp - fn)) / (n * n) AS pe FROM (
    SELECT judge AS source, it, sum(w)::DOUBLE AS n, coalesce(sum(w) FILTER (relevance AND truth), 0)::DOUBLE AS tp, coalesce(sum(w) FILTER (NOT relevance AND NOT truth), 0)::DOUBLE AS tn, coalesce(sum(w) FILTER (relevance AND NOT truth), 0)::DOUBLE AS fp, coalesce(sum(w) FILTER (NOT relevance AND truth), 0)::DOUBLE AS fn
    FROM (SELECT doc_id, judge, relevance, truth FROM v JOIN t USING (id_dataset) WHERE relevance IS NOT NULL) JOIN (SELECT it, doc_id, 1 + (it * 7 + doc_id * 13) % 3 AS w FROM range(200) r(it), documents) USING (doc_id) GROUP BY ALL)))
GROUP BY source""", TRUTH))
def bootstrap_intervals(spark, sf):
    """Weights by arithmetic, so that SQL has them too; the tests hold the seeded resamples against plain Python."""
    both = predicted_of(spark, sf).join(truth_of(spark, sf).select("item", F.col("label").alias("truth")), "item")
    pos = F.substring("item", F.lit(2), F.length("item")).cast("long")
    return rounded(agreement.bootstrap_intervals(both.withColumn("pos", pos), weights_of(spark, sf, "pos")))


@query()
def bootstrap_resamples(spark, sf):
    """The seeded resamples of an audit: 300 items, 10,000 times."""
    return agreement.resamples(spark, 300, 10_000, 0)


#: Resamples of the queries over all documents.
ITERATIONS = 200
WEIGHTS = f"wts AS (SELECT it, doc_id, 1 + (it * 7 + doc_id * 13) % 3 AS w FROM range({ITERATIONS}) r(it), documents)"
WIDE = "hw AS (SELECT doc_id, " + ", ".join(f"max(CASE WHEN annotator = '{h}' THEN relevance::INT END) AS {h}" for h in HUMANS) + " FROM h GROUP BY doc_id)"


def weights_of(spark, sf, key="item"):
    """Weights by arithmetic, so that SQL has the same."""
    return agreement.Weights(table(spark, sf, "documents").select(F.col("doc_id").alias(key)), ITERATIONS, lambda it, item: 1 + (it * 7 + item * 13) % 3)


def _kappa_sql(n: str, pa: str, pb: str, pab: str) -> str:
    po, pe = f"(({n} - {pa} - {pb} + 2 * {pab}) / {n})", f"(({pa} * {pb} + ({n} - {pa}) * ({n} - {pb})) / ({n} * {n}))"
    return f"(CASE WHEN 1 - {pe} = 0 THEN CASE WHEN abs({po} - 1) <= 1e-9 THEN 1.0 ELSE 0.0 END ELSE ({po} - {pe}) / (1 - {pe}) END)"


def _bounds_sql(names) -> str:
    return ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_ci_{e}" for m in names for q, e in ((0.025, "low"), (0.975, "high")))


def _items_long(df, name):
    return df.select(F.col("doc_id").alias("item"), F.col(name).alias("source"), F.col("relevance").alias("label"))


PAIRS = [("h1", "h2"), ("h1", "h3"), ("h2", "h3")]


@query(with_base("SELECT count(*) AS iterations, " + _bounds_sql([f"cohen_kappa_{a}_{b}" for a, b in PAIRS] + ["fleiss_kappa", "exact_agreement"]) + " FROM (SELECT " + ", ".join(_kappa_sql("n", a, b, f"{a}{b}") + f" AS cohen_kappa_{a}_{b}" for a, b in PAIRS)
    + ", (same / n - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))) AS fleiss_kappa, una / n AS exact_agreement FROM (SELECT *, (h1 + h2 + h3) / (3 * n) AS q FROM (SELECT it, sum(w)::DOUBLE AS n, "
    + ", ".join(f"sum(w * {h})::DOUBLE AS {h}" for h in HUMANS) + ", " + ", ".join(f"sum(w * {a} * {b})::DOUBLE AS {a}{b}" for a, b in PAIRS)
    + ", sum(w * CASE WHEN h1 + h2 + h3 IN (0, 3) THEN 1.0 ELSE 1.0 / 3 END) AS same, sum(w * CASE WHEN h1 + h2 + h3 IN (0, 3) THEN 1 ELSE 0 END)::DOUBLE AS una FROM hw JOIN wts USING (doc_id) GROUP BY it)))", WIDE, WEIGHTS))
def human_agreement_intervals(spark, sf):
    return rounded(agreement.human_intervals(items(humans_of(spark, sf), "annotator"), HUMANS, weights_of(spark, sf)))


BY_HUMAN = "bh AS (SELECT judge AS source, {it} " + ", ".join(f"sum(w)::DOUBLE AS n, sum(w * v.relevance::INT)::DOUBLE AS pa, sum(w * {h})::DOUBLE AS pb_{h}, sum(w * v.relevance::INT * {h})::DOUBLE AS pab_{h}" if h == "h1" else f"sum(w * {h})::DOUBLE AS pb_{h}, sum(w * v.relevance::INT * {h})::DOUBLE AS pab_{h}" for h in HUMANS) + " FROM v JOIN hw USING (doc_id) JOIN {w} USING (doc_id) WHERE v.relevance IS NOT NULL GROUP BY ALL), kh AS (SELECT source, " + ", ".join(_kappa_sql("n", "pa", f"pb_{h}", f"pab_{h}") + f" AS kappa_{h}" for h in HUMANS) + " FROM bh)"


@query(with_base("SELECT source, " + ", ".join(f"round(kappa_{h}, 6) AS kappa_{h}" for h in HUMANS) + ", round((kappa_h1 + kappa_h2 + kappa_h3) / 3, 6) AS mean_kappa FROM kh", WIDE, BY_HUMAN.format(it="", w="(SELECT doc_id, 1 AS w FROM documents)")))
def mean_kappa_by_human(spark, sf):
    return rounded(agreement.kappas_by_rater(_items_long(votes_of(spark, sf), "judge"), items(humans_of(spark, sf), "annotator"), HUMANS))


@query(with_base("SELECT source, count(*) AS iterations, " + _bounds_sql([f"kappa_{h}" for h in HUMANS] + ["mean_kappa"]) + " FROM (SELECT *, (kappa_h1 + kappa_h2 + kappa_h3) / 3 AS mean_kappa FROM kh) GROUP BY source", WIDE, WEIGHTS, BY_HUMAN.format(it="it,", w="wts")))
def mean_kappa_intervals(spark, sf):
    return rounded(agreement.rater_intervals(_items_long(votes_of(spark, sf), "judge"), items(humans_of(spark, sf), "annotator"), HUMANS, weights_of(spark, sf)))


@query(with_base("SELECT count(*) AS iterations, " + _bounds_sql(["fleiss_kappa", "unanimous_rate"]) + " FROM (SELECT (same / n - pe) / (1 - pe) AS fleiss_kappa, una / n AS unanimous_rate FROM (SELECT *, " + " + ".join(f"(t{i} / (3 * n)) * (t{i} / (3 * n))" for i in range(len(REASONS)))
    + " AS pe FROM (SELECT it, sum(w)::DOUBLE AS n, sum(w * (" + " + ".join(f"c{i} * c{i}" for i in range(len(REASONS))) + " - 3) / 6.0) AS same, sum(CASE WHEN greatest(" + ", ".join(f"c{i}" for i in range(len(REASONS))) + ") = 3 THEN w ELSE 0 END)::DOUBLE AS una, " + ", ".join(f"sum(w * c{i})::DOUBLE AS t{i}" for i in range(len(REASONS)))
    + " FROM (SELECT doc_id, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS c{i}" for i, r in enumerate(REASONS)) + " FROM h GROUP BY doc_id) JOIN wts USING (doc_id) GROUP BY it)))", WEIGHTS))
def reason_agreement_intervals(spark, sf):
    return rounded(agreement.reason_intervals(items(humans_of(spark, sf), "annotator"), 3, REASONS, weights_of(spark, sf)))


def datasets_of(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"))


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id_query"), F.col("text").alias("query"))


RAW_TOKENS = "list_filter(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'gi'), '\\s+', ' ', 'g'))), '[a-zA-ZÀ-ÿ0-9_]+'), lambda t: len(t) >= 2)"
BM25 = f"""
ds AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS description FROM documents),
terms AS (SELECT id, 'title' AS field, {RAW_TOKENS.format(x="title")} AS w FROM ds UNION ALL SELECT id, 'description', {RAW_TOKENS.format(x="description")} FROM ds),
sizes AS (SELECT field, count(*) AS docs, avg(len(w)) AS mean FROM terms GROUP BY field),
q0 AS (SELECT item_id AS id_query, text AS query FROM benchmark),
q1 AS (SELECT id_query, unnest({RAW_TOKENS.format(x="query")}) AS term FROM q0),
qtf AS (SELECT *, sum(qtf) OVER (PARTITION BY id_query) AS qlen FROM (SELECT id_query, term, count(*) AS qtf FROM q1 GROUP BY ALL)),
post AS (SELECT field, id, len, term, count(*) AS tf FROM (SELECT field, id, len(w) AS len, unnest(w) AS term FROM terms) WHERE term IN (SELECT term FROM q1) GROUP BY ALL),
dfs AS (SELECT field, term, mean, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT field, term, count(*) AS df FROM post GROUP BY ALL) JOIN sizes USING (field)),
qw AS (SELECT id_query, field, term, mean, idf * qtf * 2.2 / (qtf + 1.2 * (0.25 + 0.75 * qlen / mean)) AS qw FROM qtf JOIN dfs USING (term)),
fs AS (SELECT id_query, id, field, sum(qw * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM post JOIN qw USING (field, term) GROUP BY ALL),
fu AS (SELECT id_query, id, round(greatest(0, coalesce(max(score) FILTER (field = 'title'), 0)), 6) AS title_score, round(greatest(0, coalesce(max(score) FILTER (field = 'description'), 0)), 6) AS description_score,
  round(greatest(0, coalesce(max(score) FILTER (field = 'title'), 0)) + greatest(0, coalesce(max(score) FILTER (field = 'description'), 0)), 6) AS score FROM fs GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY id_query ORDER BY score DESC, id) AS rank FROM fu)
"""


@query("WITH " + BM25 + " SELECT id_query, id, score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 50")
def bm25_topk(spark, sf):
    return retrieval.ranked(retrieval.bm25(datasets_of(spark, sf), queries_of(spark, sf), top=50), 50).select("id_query", "id", "score", "rank")


@query("WITH " + BM25 + " SELECT id_query, id, title_score, description_score, score FROM fu")
def field_fusion(spark, sf):
    fields = [f"{f}_score" for f in ("title", "description")]
    return retrieval.bm25(datasets_of(spark, sf), queries_of(spark, sf)).select("id_query", "id", *[F.round(f, 6).alias(f) for f in fields], "score")


DENSE = """
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cos AS (SELECT a.id AS id_query, b.id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS score FROM e a, e b WHERE a.id % 100 = 0),
den AS (SELECT *, row_number() OVER (PARTITION BY id_query ORDER BY score DESC, id) AS rank FROM cos)
"""


def dense_of(spark, sf, top=100):
    """Queries are the vectors with an id divisible by 100, against all vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense(v, v.filter("id % 100 = 0").select(F.col("id").alias("id_query"), "vector"), top)


@query("WITH " + DENSE + " SELECT id_query, id, score, CAST(rank AS INTEGER) AS rank FROM den WHERE rank <= 100")
def dense_topk(spark, sf):
    return dense_of(spark, sf)


#: Three profiles of pairs from arithmetic ranks, and the pool of their first ten.
POOL = """
hits AS (SELECT doc_id % 20 AS id_query, doc_id AS id, 'lexical' AS profile, 0 AS po, (doc_id * 7) % 101 AS s FROM documents WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id % 20, doc_id, 'dense_a', 1, (doc_id * 11) % 103 FROM documents WHERE doc_id % 4 <> 2
  UNION ALL SELECT doc_id % 20, doc_id, 'dense_b', 2, (doc_id * 13) % 107 FROM documents WHERE doc_id % 5 <> 3),
ranks AS (SELECT id_query, id, profile, po, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY profile, id_query ORDER BY s DESC, id) AS rank FROM hits),
top AS (SELECT * FROM ranks WHERE rank <= 10)
"""


def profile_ranks(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("id_query"), F.col("doc_id").alias("id"))
    rules = {"lexical": (3, 1, 7, 101), "dense_a": (4, 2, 11, 103), "dense_b": (5, 3, 13, 107)}
    return {p: retrieval.ranked(d.filter(F.col("id") % m != r).withColumn("score", ((F.col("id") * a) % b).cast("double")), 2**31 - 1) for p, (m, r, a, b) in rules.items()}


@query("WITH " + POOL + """
SELECT id_query, id, CAST(count(*) AS INTEGER) AS n_profiles, string_agg(profile || ':' || rank, ',' ORDER BY po) AS provenance,
  CAST(row_number() OVER (PARTITION BY id_query ORDER BY min(po), arg_min(rank, po), id) - 1 AS INTEGER) AS result_index FROM top GROUP BY id_query, id""")
def candidate_pool(spark, sf):
    pool = retrieval.pooled(profile_ranks(spark, sf), 10)
    text = F.array_join(F.transform(F.map_entries("retrieval"), lambda e: F.concat_ws(":", e["key"], e["value"]["rank"].cast("string"))), ",")
    return pool.select("id_query", "id", "n_profiles", text.alias("provenance"), "result_index")


@query("WITH " + POOL + ", flags AS (SELECT id_query, id, " + ", ".join(f"max((profile = '{p}')::INT) AS p{i}" for i, p in enumerate(PROFILES)) + " FROM top GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT '{p}' AS profile, count(*) FILTER (p{i} = 1) AS retrieved_pairs, count(*) FILTER (p{i} = 1 AND p0 + p1 + p2 = 1) AS exclusive_pairs, round(count(*) FILTER (p{i} = 1 AND p0 + p1 + p2 = 1) / count(*) FILTER (p{i} = 1), 6) AS exclusive_rate, "
        + ", ".join(f"round(count(*) FILTER (p{i} = 1 AND p{j} = 1) / count(*) FILTER (p{i} = 1 OR p{j} = 1), 6) AS jaccard_with_{q}" for j, q in enumerate(PROFILES)) + " FROM flags" for i, p in enumerate(PROFILES)))
def pool_diversity(spark, sf):
    return rounded(ireval.diversity(retrieval.memberships(retrieval.pooled(profile_ranks(spark, sf), 10)), PROFILES))


@query(with_base("""
, rel AS (SELECT doc_id % 20 AS id_query, doc_id AS id, relevance FROM v WHERE k = 2 AND relevance IS NOT NULL),
tot AS (SELECT id_query, count(*) FILTER (relevance) AS r FROM rel GROUP BY id_query HAVING count(*) FILTER (relevance) > 0),
pq AS (SELECT profile, id_query, r, """ + ", ".join(f"sum(CASE WHEN relevance AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(r, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}, count(*) FILTER (relevance AND rank <= {k}) / r AS recall_{k}" for k in (10, 50)) + """
  FROM ranks JOIN rel USING (id_query, id) JOIN tot USING (id_query) GROUP BY profile, id_query, r)
SELECT profile, round(avg(ndcg_10), 6) AS ndcg_at_10, round(avg(ndcg_50), 6) AS ndcg_at_50, round(avg(recall_10), 6) AS recall_at_10, round(avg(recall_50), 6) AS recall_at_50, count(*) AS queries_evaluated FROM pq GROUP BY profile""", POOL))
def retrieval_effectiveness(spark, sf):
    ranks = None
    for p, hits in profile_ranks(spark, sf).items():
        part = hits.select(F.lit(p).alias("profile"), "id_query", "id", "rank")
        ranks = part if ranks is None else ranks.unionByName(part)
    rel = votes_of(spark, sf).filter("judge = 'judge_c' and relevance is not null").select("id_query", F.col("doc_id").alias("id"), F.col("relevance").alias("relevant"))
    return rounded(ireval.effectiveness(ranks, rel))


@query("WITH " + POOL + " SELECT profile, id_query, count(*) AS n, count(DISTINCT rank) AS n_ranks, min(rank) AS first_rank, max(rank) AS last_rank, count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*) AS ok FROM top GROUP BY ALL")
def rank_contiguity_report(spark, sf):
    return contracts.contiguous_ranks(retrieval.memberships(retrieval.pooled(profile_ranks(spark, sf), 10)), ["profile", "id_query"])


@query(with_base("SELECT v.id_query, id_dataset, judge, relevance FROM v WHERE doc_id IN (SELECT doc_id FROM labels)"))
def pair_filter_semi(spark, sf):
    return votes_of(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("id_query", "id_dataset", "judge", "relevance")


@query(with_base("SELECT id_query, id_dataset FROM pairs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"))
def missing_pairs_anti(spark, sf):
    return pairs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("id_query", "id_dataset")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT o_custkey + 5 AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 3) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def coverage_full_outer(spark, sf):
    """Keys of one side only, of both sides: those of orders are shifted, and some customers are left out."""
    b = table(spark, sf, "customer").filter("c_custkey % 10 != 3").select(F.col("c_custkey").alias("k"))
    return contracts.key_differences(table(spark, sf, "orders").select((F.col("o_custkey") + 5).alias("k")), b, ["k"])


@query(with_base("SELECT pairs.id_query, pairs.id_dataset, a.majority_relevance, a.majority_reason, a.majority_relevance IS NOT NULL AS audited FROM pairs LEFT JOIN (SELECT id_dataset, truth AS majority_relevance, why AS majority_reason FROM t WHERE id_dataset IN (SELECT 'd' || doc_id FROM labels)) a USING (id_dataset)", TRUTH))
def human_audit_left_join(spark, sf):
    sampled = humans_of(spark, sf).join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    audit = assemble.audits(sampled, 3)
    out = pairs_of(spark, sf).join(audit, ["id_query", "id_dataset"], "left")
    return out.select("id_query", "id_dataset", "human_audit.majority_relevance", "human_audit.majority_reason", F.col("human_audit").isNotNull().alias("audited"))


@query(with_base("SELECT id_query, id_dataset, judge AS model FROM v WHERE relevance IS NULL"))
def pending_annotations(spark, sf):
    done = votes_of(spark, sf).select("id_query", "id_dataset", F.col("judge").alias("model"), F.when(F.col("relevance").isNull(), "invalid_json").alias("error"))
    return judge.pending(pairs_of(spark, sf), spark.createDataFrame([(j,) for j in JUDGES], "model string"), done)


@query(with_base("SELECT id_query, id_dataset, judge AS model, reason, CASE WHEN relevance IS NULL THEN 'invalid_schema' END AS error FROM v"))
def annotation_upsert(spark, sf):
    v = votes_of(spark, sf).select("id_query", "id_dataset", F.col("judge").alias("model"), "reason", F.when(F.col("relevance").isNull(), "invalid_schema").alias("error"))
    old = v.withColumn("reason", F.lit("unrelated")).withColumn("error", F.when(F.col("error").isNull(), "invalid_json"))
    return judge.merged(old.filter("error is not null"), v)


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS kept, array_to_string(list_sort(list(doc_id))[2:], ',') AS duplicates FROM documents GROUP BY text HAVING count(*) > 1")
def metadata_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    out = collection.duplicate_groups(d.withColumn("ord", F.col("doc_id")), ["text_md5"], "doc_id", "ord")
    return out.select("text_md5", "n", "kept", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY (doc_id % 3 = 0) DESC, (doc_id % 2 = 0) DESC, 'p' || lpad(CAST((doc_id * 37) % 1000 AS VARCHAR), 4, '0'), doc_id) = 1 AS kept FROM documents""")
def resource_dedup_preferred(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), F.when(i % 3 == 0, "utf-8").otherwise("latin-1").alias("encoding"), F.when(i % 2 == 0, ";").otherwise(",").alias("delimiter"), F.concat(F.lit("p"), F.lpad(((i * 37) % 1000).cast("string"), 4, "0")).alias("path"), i.alias("ord"))
    return collection.preferred(d, ["hash"]).select("doc_id", "kept")


@query("""SELECT source, count(*) AS resources, count(*) FILTER (NOT invalid) AS valid, bool_and(invalid) AS empty FROM (SELECT source,
  CASE WHEN doc_id % 13 = 0 THEN true ELSE len(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\\S'))) < 3 OR doc_id % 17 = 0 END AS invalid FROM documents) GROUP BY source""".replace("\\\\", "\\"))
def resource_validity(spark, sf):
    i = F.col("doc_id")
    bad = collection.invalid_resource(F.when(i % 13 != 0, "p"), F.lit("f.csv"), collection.nonblank_lines(F.col("text")), F.when(i % 17 != 0, F.array(F.lit("a"))), 2)
    return table(spark, sf, "documents").select("source", bad.alias("invalid")).groupBy("source").agg(F.count("*").alias("resources"), F.count_if(~F.col("invalid")).alias("valid"), F.min("invalid").alias("empty"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_orderkey * 31 + l_linenumber * 7) % 1009, l_orderkey * 10 + l_linenumber) <= 20")
def row_sample_per_table(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("row_no", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return collection.sampled_rows(x, "l_suppkey", "row_no", 20, order=(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 1009).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) AND lang NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def disjunctive_anti_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return collection.without(d, d.filter("doc_id % 97 = 0").select(F.col("source").alias("name")).distinct(), ["source", "lang"]).select("doc_id", "source")


@query()
def human_sample(spark, sf):
    """Python's own seeded sample; SQL has no such generator."""
    p = pairs_of(spark, sf).select(T.pair_key(F.col("id_query"), F.col("id_dataset")).alias("pair_key"))
    return sampling.exact_sample(p, 100, 1)


@query(with_base("SELECT sum(n)::BIGINT AS pairs, count(*) AS queries, min(n) AS least, max(n) AS most FROM (SELECT id_query, count(*) AS n FROM pairs WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY id_query)"))
def sample_summary(spark, sf):
    return sampling.sample_summary(pairs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normalized FROM documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.document_text(F.col("text")).alias("normalized"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))[:2048] AS model_text FROM documents")
def model_text(spark, sf):
    """What an embedding model is given: the first 2,048 characters of a normalised text, a limit that is the feature."""
    return table(spark, sf, "documents").select("doc_id", T.model_text(F.col("text")).alias("model_text"))


@query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {RAW_TOKENS.format(x='text')} AS w FROM documents)")
def bm25_tokens(spark, sf):
    w = T.lexical_tokens(F.col("text"), entities=False)
    return spread(table(spark, sf, "documents")).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query()
def query_normalize(spark, sf):
    """Look-behind patterns, which RE2 lacks."""
    return table(spark, sf, "benchmark").select("item_id", T.query_text(F.col("text")).alias("normalized"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'gi'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_url_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.squeezed(T.without_markup(F.col("html")))).alias("text_md5"))


@query("""SELECT doc_id, '{"reason": "' || (CASE WHEN doc_id % 2 = 0 THEN 'direct_match' ELSE 'generic' END) || '", "n": [1, ' || doc_id || ']}' AS cleaned FROM documents""")
def llm_output_clean(spark, sf):
    i = F.col("doc_id").cast("string")
    reason = F.when(F.col("doc_id") % 2 == 0, "direct_match").otherwise("generic")
    raw = F.concat(F.lit('```json\n{"reason": "'), reason, F.lit('",\r "n": [1, '), i, F.lit(', ],}\n```'))
    return table(spark, sf, "documents").select("doc_id", T.cleaned_output(raw).alias("cleaned"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'invalid_json' WHEN doc_id % 4 IN (1, 3) THEN 'invalid_schema' END AS error, CASE WHEN doc_id % 4 = 2 THEN 'subtype' END AS reason, CASE WHEN doc_id % 4 = 2 THEN true END AS relevance FROM documents""")
def judgment_parse(spark, sf):
    i = F.col("doc_id") % 4
    good = '{"main_resource": "a", "scope": null, "supporting_field": "title", "quote": "q", "reason": "subtype"}'
    raw = F.when(i == 0, "no json {here").when(i == 1, "[1, 2]").when(i == 2, f"Sure: {good} done").otherwise(good.replace("subtype", "maybe"))
    a = judge.parsed(raw)
    return table(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.error", "a.reason", "a.relevance")


@query("""SELECT conv_id, turn, md5('Decide whether the dataset satisfies the need behind the query. Judge only from the fields that are given.' || chr(10) || 'Query: ' || role || chr(10) || 'Title: ' || role || chr(10) || 'Content: ' || coalesce(text, '')[:500] || chr(10) ||
  'Answer with one JSON object with the keys "main_resource", "scope", "supporting_field", "quote" and "reason".') AS prompt_md5 FROM conversations""")
def prompt_build(spark, sf):
    p = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("query"), F.col("role").alias("title"), F.col("text").alias("content"))
    return judge.prompts(p, fields=("title", "content")).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


def _benchmark(spark, sf):
    v = votes_of(spark, sf).withColumn("error", F.when(F.col("relevance").isNull(), "invalid_json"))
    usable = v.filter("judge = 'judge_c' and relevance is not null").select("id_query", "id_dataset")
    sampled = humans_of(spark, sf).join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    pool = pairs_of(spark, sf).select("id_query", "id_dataset").join(usable, ["id_query", "id_dataset"], "left_semi")
    own = v.join(usable, ["id_query", "id_dataset"], "left_semi")
    return assemble.assembled(pool, own, "judge_c", assemble.audits(sampled, 3), JUDGES)


ASSEMBLED = """
ok AS (SELECT id_query, id_dataset, relevance AS default_relevance FROM v WHERE k = 2 AND relevance IS NOT NULL),
ass AS (SELECT ok.*, (SELECT count(*) FROM v WHERE v.id_dataset = ok.id_dataset AND v.relevance) AS positive_judges, t.truth, t.id_dataset IS NOT NULL AS audited FROM ok LEFT JOIN (SELECT * FROM t WHERE id_dataset IN (SELECT 'd' || doc_id FROM labels)) t USING (id_dataset))
"""


@query(with_base("SELECT id_query, id_dataset, default_relevance, CAST(positive_judges AS INTEGER) AS positive_judges, truth AS audit_relevance FROM ass", TRUTH, ASSEMBLED))
def benchmark_assemble(spark, sf):
    n = F.size(F.filter(F.map_values("annotations"), lambda a: F.coalesce(a["relevance"], F.lit(False))))
    return _benchmark(spark, sf).select("id_query", "id_dataset", "default_relevance", n.alias("positive_judges"), F.col("human_audit.majority_relevance").alias("audit_relevance"))


@query(with_base("SELECT count(*) AS pairs, count(DISTINCT id_query) AS queries, count(*) FILTER (default_relevance) AS relevant, count(*) FILTER (NOT default_relevance) AS non_relevant, 0::BIGINT AS missing, count(*) FILTER (audited) AS audited, count(*) FILTER (truth) AS audit_relevant FROM ass", TRUTH, ASSEMBLED))
def release_summary(spark, sf):
    return assemble.release_summary(_benchmark(spark, sf))


@query("SELECT o_custkey AS id_query, 'o' || o_orderkey AS id_dataset, 'changed' AS difference FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_custkey, 'o' || o_orderkey, 'missing' FROM orders WHERE o_orderkey % 50 = 1")
def roundtrip_check(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id_query"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("id_dataset"), "o_orderkey", "o_totalprice")
    back = o.filter("o_orderkey % 50 != 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return assemble.round_trip(o, back, ["o_totalprice"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN false END AS parsed FROM documents")
def strict_boolean(spark, sf):
    i = F.col("doc_id") % 4
    return table(spark, sf, "documents").select("doc_id", T.strict_bool(F.when(i == 0, " TRUE ").when(i == 1, "false").when(i == 2, "yes")).alias("parsed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS q, CASE WHEN doc_id % 3 = 0 THEN source END AS d FROM documents")
def pair_key_parse(spark, sf):
    i = F.col("doc_id")
    key = F.when(i % 3 == 0, F.concat(F.lit(" "), i, F.lit("|| "), F.col("source"))).when(i % 3 == 1, F.concat(i, F.lit("||x||"), F.col("source"))).otherwise(F.concat(i, F.lit("|| ")))
    return table(spark, sf, "documents").select("doc_id", T.parsed_pair(key).alias("p")).select("doc_id", F.col("p.id_query").alias("q"), F.col("p.id_dataset").alias("d"))


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)")
def point_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.uuid5(F.col("doc_id").cast("string")).alias("point_id"))


@query("SELECT DISTINCT source || '|\"a b\"|' || lang AS header FROM documents")
def header_compose(spark, sf):
    names = F.array(F.concat(F.lit(" "), F.col("source")), F.lit("a b"), F.lit(" "), F.col("lang"))
    return table(spark, sf, "documents").select(T.header_line(names, F.lit("|")).alias("header")).distinct()


@query("SELECT doc_id AS id, trim(string_split(text, chr(10))[1]) AS title, md5(trim(text)) AS description_md5, 'x' AS header, 'r' || chr(10) || 'c' AS content, trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))[:2048] AS dense_title_text, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))[:2048]) AS dense_description_md5 FROM documents WHERE trim(string_split(text, chr(10))[1]) <> '' AND doc_id % 5 <> 0")
def dataset_records(spark, sf):
    d = datasets_of(spark, sf).select(F.col("id").cast("string").alias("identifier"), F.lit("m").alias("meta_file"), "title", F.when(F.col("id") % 5 != 0, F.col("description")).alias("description"), F.array(F.lit("x")).alias("field_names"), F.lit(";").alias("delimiter"), F.lit("r").alias("rows_text"), F.lit("c").alias("columns_text"))
    return collection.dataset_records(d).select(F.col("id").cast("long").alias("id"), "title", F.md5("description").alias("description_md5"), "header", "content", "dense_title_text", F.md5("dense_description_text").alias("dense_description_md5"))


@query("WITH " + POOL + " SELECT profile, count(*) AS memberships, count(DISTINCT id_query) AS queries, (SELECT count(*) FROM (SELECT DISTINCT id_query, id FROM top)) AS pool_pairs FROM top GROUP BY profile")
def pool_summary(spark, sf):
    return retrieval.pool_summary(retrieval.memberships(retrieval.pooled(profile_ranks(spark, sf), 10)))


@query(with_base("SELECT judge, count(*) AS n, CASE judge WHEN 'judge_a' THEN 'Judge A' WHEN 'judge_b' THEN 'Judge B' ELSE judge END AS display_name FROM v GROUP BY judge"))
def display_name_lookup(spark, sf):
    n = votes_of(spark, sf).groupBy("judge").agg(F.count("*").alias("n"))
    return votes.with_display_names(n, {"judge_a": "Judge A", "judge_b": "Judge B"})


@query("SELECT source, count(*) AS n_a, count(*) - count(*) FILTER (doc_id % 300 = 7) AS n_b FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 300 = 7) GROUP BY source")
def ordered_sequence_differences(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    out = contracts.order_differences(d, d.filter("doc_id % 300 != 7"), "source", "doc_id", "doc_id")
    return out.select("source", F.col("n_a").cast("long").alias("n_a"), F.greatest("n_b", F.lit(0)).cast("long").alias("n_b"))


@query("""WITH r AS (SELECT 'm' || (doc_id % 50) AS meta_file, 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.csv' WHEN doc_id % 3 = 1 THEN '.TSV' ELSE '.pdf' END AS file_name, doc_id FROM documents)
SELECT r.file_name, count(*) AS source_rows, least(count(*), 3) AS sampled_rows FROM r JOIN lineitem ON l_orderkey = doc_id
WHERE doc_id % 50 <> 7 AND doc_id % 11 <> 4 AND doc_id % 3 < 2 GROUP BY r.file_name""")
def collection_reduction(spark, sf):
    i = F.col("doc_id")
    ending = F.when(i % 3 == 0, ".csv").when(i % 3 == 1, ".TSV").otherwise(".pdf")
    r = table(spark, sf, "documents").select(F.concat(F.lit("m"), i % 50).alias("meta_file"), F.concat(F.lit("f"), i, ending).alias("file_name"), F.concat(F.lit("p"), i).alias("path"), F.lit("k").alias("res_key"), "doc_id")
    rows = r.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == i).select("file_name", F.col("l_linenumber").alias("row_no"))
    _, _, counts = collection.reduced_collection(r, rows, r.filter(i % 50 == 7).select("meta_file").distinct(), r.filter(i % 11 == 4).select(F.col("path").alias("name")), 3)
    return counts.select("file_name", "source_rows", F.col("sampled_rows").cast("long").alias("sampled_rows"))


@query("SELECT item_id, strip_accents(text) AS plain FROM benchmark")
def accent_strip(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.without_accents(F.col("text")).alias("plain"))


@query("SELECT 'm' || (doc_id % 40) AS meta_file, min(doc_id) AS first_doc FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def first_resource_with_path(spark, sf):
    i = F.col("doc_id")
    r = table(spark, sf, "documents").select(F.concat(F.lit("m"), i % 40).alias("meta_file"), F.when(i % 5 != 0, "p").alias("path"), i.alias("ord"), "doc_id")
    return collection.first_with_path(r).select("meta_file", F.col("doc_id").alias("first_doc"))


@query("SELECT item_id, 'Instruct: Retrieve semantically similar text' || chr(10) || 'Query: ' || lower(trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))) || '! yes, ' || item_id || '?!' AS prompt FROM benchmark")
def query_prompts(spark, sf):
    """Whole prompts: the texts without marks, so that SQL can say what the marks that are added become."""
    q = F.concat(F.regexp_replace("text", "[^a-zA-Z0-9]+", "  "), F.lit("!!!yes ,"), F.col("item_id"), F.lit("??!?"))
    return table(spark, sf, "benchmark").select("item_id", retrieval.query_prompt(q).alias("prompt"))


@query("WITH " + BM25 + " SELECT id_query, id, score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 20")
def profile_retrieval(spark, sf):
    """The lexical profile by its old name, through the registry of profiles."""
    r = retrieval.Retriever(datasets_of(spark, sf)).add("bm25", T.Analyzer(entities=False))
    return r.search("lexical", queries_of(spark, sf), 20).select("id_query", "id", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import formats  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import formats  # noqa: F401

    return dict(SQL)
