"""Operators against hand-computed rows, published counts and plain Python."""

import itertools
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from relspark import config
from relspark.config import RELEVANCE, ContractError, Settings
from relspark.functions import metrics as M
from relspark.functions import text as T
from relspark.operators import agreement, assemble, collection, contracts, ireval, judge, retrieval, sampling, votes
from relspark.plans import queries
from relspark.sources import readers, writers
from relspark.streaming import resume

#: How many of 300 audited items have each combination of three human labels.
HUMAN_CELLS = {
    (False, False, False): 107,
    (False, False, True): 3,
    (False, True, False): 17,
    (False, True, True): 7,
    (True, False, False): 0,
    (True, False, True): 2,
    (True, True, False): 7,
    (True, True, True): 157,
}
#: How many items of each of these cells, in the same order, one judge labels relevant.
JUDGE_CELLS = (3, 0, 0, 3, 0, 1, 2, 145)
#: Pairs of a pool by membership in three profiles.
POOL_CELLS = {
    (1, 0, 0): 3030,
    (0, 1, 0): 3343,
    (0, 0, 1): 3618,
    (1, 1, 0): 406,
    (1, 0, 1): 131,
    (0, 1, 1): 986,
    (1, 1, 1): 265,
}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def humans(spark):
    rows, n = [], 0
    for cell, count in HUMAN_CELLS.items():
        for _ in range(count):
            rows += [(n, f"h{k + 1}", v) for k, v in enumerate(cell)]
            n += 1
    return spark.createDataFrame(rows, "item int, rater string, label boolean").cache()


def test_human_agreement_is_as_published(humans):
    got = {(r.rater_a, r.rater_b): r.cohen_kappa for r in agreement.pairwise_kappa(humans, ["h1", "h2", "h3"]).collect()}
    want = {("h1", "h2"): 0.8218527315914489, ("h1", "h3"): 0.8851144350333394, ("h2", "h3"): 0.8002571402332629}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(agreement.fleiss_kappa(humans, 3, "label").first().fleiss_kappa - 0.8356756318119806) < 1e-12
    assert agreement.exact_agreement(humans, 3).first().exact_agreement == 0.88


def test_judge_against_humans_is_as_published(spark, humans):
    rows, n = [], 0
    for (cell, count), k in zip(HUMAN_CELLS.items(), JUDGE_CELLS, strict=True):
        rows += [(n + i, "judge", i < k, sum(cell) >= 2) for i in range(count)]
        n += count
    df = spark.createDataFrame(rows, "item int, source string, label boolean, truth boolean")
    r = agreement.confusion(df.drop("truth"), df.select("item", F.col("truth").alias("label"))).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (151, 124, 3, 22)
    want = {"kappa": 0.8326490539093181, "precision": 0.9805194805194806, "recall": 0.8728323699421965, "f1": 0.9235474006116208}
    assert all(abs(r[k] - v) < 1e-12 for k, v in want.items())
    assert abs(agreement.mean_kappa(df, humans).first().mean_kappa - 0.7968025440141192) < 1e-12


def test_pool_diversity_is_as_published(spark):
    rows, n = [], 0
    for cell, count in POOL_CELLS.items():
        for _ in range(count):
            rows += [(1, n, p) for p, on in zip("abc", cell, strict=True) if on]
            n += 1
    got = {r.profile: r for r in ireval.diversity(spark.createDataFrame(rows, "id_query int, id int, profile string"), list("abc")).collect()}
    assert [got[p].retrieved_pairs for p in "abc"] == [3832, 5000, 5000] and [got[p].exclusive_pairs for p in "abc"] == [3030, 3343, 3618]
    assert abs(got["a"].jaccard_with_b - 0.08222031613772822) < 1e-12 and abs(got["b"].jaccard_with_c - 0.14298777003086066) < 1e-12 and got["c"].jaccard_with_c == 1


def test_majorities_of_all_votes(spark):
    every = list(itertools.product((True, False, None), repeat=3))
    rows = [(1, f"d{i}", f"j{k}", v) for i, vs in enumerate(every) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id_query int, id_dataset string, judge string, relevance boolean")
    strict = {r.id_dataset: (r.valid_votes, r.aggregated_relevance) for r in votes.panels(df, ["j0", "j1", "j2"]).collect()}
    loose = {r.id_dataset: r.majority for r in votes.available_majority(df).collect()}
    for i, vs in enumerate(every):
        n, p = sum(v is not None for v in vs), sum(v is True for v in vs)
        assert strict[f"d{i}"] == (n, p >= 2 if n == 3 else None)
        assert loose[f"d{i}"] == (None if 2 * p == n else 2 * p > n)
    summary = votes.panel_summary(votes.panels(df.filter("relevance is null"), ["j0", "j1", "j2"])).first()
    assert summary.valid == 0 and summary.positive_rate is None


def test_panels_of_five_judges_keep_their_order(spark):
    df = spark.createDataFrame([(1, "d", j, True) for j in "edcba"], "id_query int, id_dataset string, judge string, relevance boolean")
    names = [r.combination for r in votes.panels(df, list("ebcda")).orderBy("panel_order").collect()]
    assert names == [" + ".join(x) for x in itertools.combinations("ebcda", 3)]


def test_reason_majority_counts_missing_raters(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", None), ("b", None), ("c", "x"), ("c", "y"), ("c", "z")]
    got = {r.id_dataset: r.majority_reason for r in votes.reason_majority(spark.createDataFrame([(1, d, r) for d, r in rows], "id_query int, id_dataset string, reason string")).collect()}
    assert got == {"a": "x", "b": None, "c": None}


@pytest.mark.parametrize("counts,want", [((0, 0, 0, 0), None), ((5, 5, 5, 5), 1.0), ((4, 4, 0, 0), 0.0), ((10, 5, 5, 5), 1.0), ((10, 5, 5, 0), -1.0)])
def test_kappa_edges(spark, counts, want):
    got = spark.createDataFrame([counts], "n long, a long, b long, p long").select(M.cohen_kappa(*[F.col(c) for c in "nabp"])).first()[0]
    assert got == want


def test_kappa_is_symmetric(spark):
    r = random.Random(1)
    rows = [(i, rater, r.random() < 0.5 if r.random() < 0.9 else None) for i in range(200) for rater in "ab"]
    df = spark.createDataFrame(rows, "item int, rater string, label boolean")
    a, b = (agreement.pairwise_kappa(df, list(x)).first() for x in ("ab", "ba"))
    assert abs(a.cohen_kappa - b.cohen_kappa) < 1e-12 and a.n == b.n


def test_bootstrap_against_plain_python(spark):
    r, n, its = random.Random(3), 40, 150
    rows = [(i, "s", r.random() < 0.6, r.random() < 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "pos int, source string, label boolean, truth boolean")
    weights = agreement.resamples(spark, n, its, 0)
    got = agreement.bootstrap_intervals(df, weights).first()
    draw, values = random.Random(0), []
    for _ in range(its):
        x = [rows[draw.randrange(n)] for _ in range(n)]
        tp, fp = sum(a and b for *_, a, b in x), sum(a and not b for *_, a, b in x)
        values.append(tp / (tp + fp) if tp + fp else 0.0)
    values.sort()
    at = lambda q: values[math.floor(q * (its - 1))] + (q * (its - 1) % 1) * (values[math.ceil(q * (its - 1))] - values[math.floor(q * (its - 1))])
    assert abs(got.precision_ci_low - at(0.025)) < 1e-9 and abs(got.precision_ci_high - at(0.975)) < 1e-9
    assert weights.groupBy("iteration").agg(F.sum("w").alias("w")).filter(f"w != {n}").count() == 0


def test_ranking_metrics(spark):
    rel = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", True), (1, "x", True), (2, "a", False)], "id_query int, id string, relevant boolean")
    ranks = spark.createDataFrame([("p", 1, "a", 1), ("p", 1, "b", 2), ("p", 1, "c", 3), ("p", 2, "a", 1), ("best", 1, "a", 1), ("best", 1, "c", 2), ("best", 1, "x", 3)], "profile string, id_query int, id string, rank int")
    got = {r.profile: r for r in ireval.effectiveness(ranks, rel, (2, 10)).collect()}
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert abs(got["p"].ndcg_at_10 - 1.5 / ideal) < 1e-12 and abs(got["p"].recall_at_2 - 1 / 3) < 1e-12 and got["p"].queries_evaluated == 1
    assert abs(got["best"].ndcg_at_2 - 1) < 1e-12 and got["best"].ndcg_at_10 == pytest.approx(1)


def test_fusion_clamps_and_fills(spark):
    df = spark.createDataFrame([(1, "a", "title", -2.0), (1, "a", "description", 1.0), (1, "b", "title", 1.0), (1, "c", "description", -1.0)], "id_query int, id string, field string, score double")
    got = [(r.id, r.score, r.rank) for r in retrieval.ranked(retrieval.fused(df)).orderBy("rank").collect()]
    assert got == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.0, 3)]


def test_bm25_against_plain_python(spark):
    docs = [("1", "red fox", "a red fox jumps"), ("2", "blue", "the blue fox fox"), ("3", "", "nothing here"), ("4", "red red", "red")]
    q = "red fox red"
    d = spark.createDataFrame(docs, "id string, title string, description string")
    got = {(r.id, f): r[f"{f}_score"] for r in retrieval.bm25(d, spark.createDataFrame([(1, q)], "id_query int, query string")).collect() for f in ("title", "description")}
    for f, at in (("title", 1), ("description", 2)):
        bags = {x[0]: [t for t in x[at].split() if len(t) > 1] for x in docs}
        mean = sum(map(len, bags.values())) / 4
        sat = lambda tf, n, m=mean: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))
        for i, bag in bags.items():
            s = sum(sat(q.split().count(t), 3) * sat(bag.count(t), len(bag)) * math.log1p((4 - n + 0.5) / (n + 0.5)) for t in ("red", "fox") if t in bag and (n := sum(t in b for b in bags.values())))
            assert abs(got.get((i, f), 0.0) - s) < 1e-9


def test_dense_is_exact_and_ties_are_by_id(spark):
    r = random.Random(2)
    vs = [[r.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    vs += [vs[3], [0.0] * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id int, vector array<double>")
    got = [(x.id, x.score) for x in retrieval.dense(df, df.filter("id = 3").select(F.col("id").alias("id_query"), "vector"), 7).orderBy("rank").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(b) else 0.0
    want = sorted(((i, round(cos(vs[3], v), 6)) for i, v in enumerate(vs)), key=lambda x: (-x[1], x[0]))[:7]
    assert got == want and got[0][0] == 3 and got[1][0] == 60


def test_pool_order_and_provenance(spark):
    hits = lambda xs: spark.createDataFrame([(1, i, s, r) for i, s, r in xs], "id_query int, id string, score double, rank int")
    pool = retrieval.pooled({"b": hits([("x", 3.0, 1), ("y", 2.0, 2), ("z", 1.0, 3)]), "a": hits([("w", 9.0, 1), ("x", 8.0, 2)])}, 2)
    rows = pool.orderBy("result_index").collect()
    assert [r.id for r in rows] == ["x", "y", "w"] and rows[0].retrieval["a"].rank == 2 and rows[0].n_profiles == 2
    renamed = pool.select(retrieval.renamed_profiles(F.col("retrieval"), {"b": "lex"}).alias("m")).collect()
    assert any("lex" in r.m for r in renamed)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        pool.select(retrieval.renamed_profiles(F.col("retrieval"), {"b": "a"})).collect()


def test_bm25_keeps_the_best_of_each_query(spark, monkeypatch):
    """What tasks pass on holds the first `top` of each query, ties included, over several blocks of queries."""
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 23}" for k in range(1, 9)), f"t{i % 7} t{i % 5}") for i in range(1_500)], "id long, title string, description string").repartition(5)
    q = spark.createDataFrame([(i, f"t{i} t{i + 3} t{i % 4}") for i in range(12)], "id_query int, query string")
    key = lambda df: [(r.id_query, r.id, r.score, r.rank) for r in retrieval.ranked(df, 10).orderBy("id_query", "rank").collect()]
    whole = key(retrieval.bm25(docs, q))
    monkeypatch.setattr(retrieval, "LEXICAL_BLOCK", 5)
    few = retrieval.bm25(docs, q, top=10)
    assert key(few) == whole and few.count() < retrieval.bm25(docs, q).count()


ODD = ["", None, "a", "é à ÿÿ ab_9 x", "Ñandú ÀÉ×÷ ÏÎ\u0130x", "ab<i\nb>cd HTTPS://X.y/z\u00a0t WWW.a.b é", "1 < 2", "日本ab語cd\U0001f600ef", "fox-fox fox", "œuvre žluť ſab K9 Σας", "xé", "éx ab", "fox" * 50]


def _odd_documents(spark):
    return spark.createDataFrame([(i, t, None if t is None else f"{t}\n{ODD[i - 1]} fox") for i, t in enumerate(ODD)], "id int, title string, description string").coalesce(2)


def test_bm25_finds_tokens_in_bytes(spark):
    """lists of terms don't leave the JVM, and lengths, counts and scores are those of the Analyzer's term lists."""
    docs, q = _odd_documents(spark), spark.createDataFrame([(i, t or "fox ab cd") for i, t in enumerate(ODD)], "id_query int, query string")
    assert "regexp_extract_all" not in retrieval.bm25(docs, q)._jdf.queryExecution().toString()
    for analyzer in (T.Analyzer(markup=False, least=1), T.Analyzer(least=3, chars=7)):
        fields = ("title", "description")
        lists = retrieval.analysed(docs, fields, analyzer)
        want = {(r.id_query, r.id): r[2:] for r in retrieval.scored_terms(lists, q, fields, analyzer).collect()}
        got = {(r.id_query, r.id): r[2:] for r in retrieval.bm25(docs, q, fields, analyzer).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k], strict=True)) and got
        ends = {r.id: [len(r.title), len(r.description)] for r in lists.collect()}
        assert {i: [int(n) for n in ns] for i, ns in zip(*_lengths(analyzer.lowered(docs, fields), analyzer.least), strict=True)} == ends


def _lengths(texts, least):
    t = texts.toArrow().combine_chunks()
    return t["id"].to_pylist(), list(zip(*[retrieval._tokens(t[f].combine_chunks(), least)[0] for f in ("title", "description")], strict=True))


def test_lexical_profile_finds_tokens_in_bytes(spark, tmp_path):
    """the registry's search takes that way too, and a stored index of term lists gives the same."""
    docs, q = _odd_documents(spark), spark.createDataFrame([(1, "fox ab"), (2, "ÉX")], "id_query int, query string")
    r = retrieval.Retriever(docs).add("bm25", T.Analyzer(entities=False))
    found = r.search("lexical", q, 5)
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    r.build(f"file://{tmp_path}/index")
    rows = [[(x.id_query, x.id, x.score, x["rank"]) for x in df.orderBy("id_query", "rank").collect()] for df in (found, r.open(f"file://{tmp_path}/index").search("lexical", q, 5))]
    assert rows[0] == rows[1] and len(rows[0]) > 5


def test_fused_scores_are_rounded_once(spark, tmp_path):
    """the score of a pair is rounded where it is made, so each of its rows costs two roundings, not four."""
    docs = [(i, f"{t or ''}\nfox ab cd {'ef ' * i}") for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "fox ef"), (2, "ab xé")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    df = queries.field_fusion(spark, f"file://{tmp_path}")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("round(") == 2
    rows = df.collect()
    assert len(rows) == 2 * len(ODD) and all(r.score == round(r.score, 6) and abs(r.score - r.title_score - r.description_score) < 2e-6 for r in rows)


def test_retriever_profiles(spark, tmp_path):
    docs = spark.createDataFrame([("1", "red fox", "jumps"), ("2", "blue", "fox"), ("3", "x", "y")], "id string, title string, description string")
    q = spark.createDataFrame([(1, "red fox"), (2, "blue")], "id_query int, query string")
    encode = lambda texts: [[float("fox" in t), float("blue" in t), 0.1] for t in texts]
    r = retrieval.Retriever(docs).add("bm25", T.Analyzer(stopwords=("red",), morphology=lambda ts: [t.rstrip("s") for t in ts])).add("dense", encode)
    before = {n: r.search(n, q).orderBy("id_query", "rank").collect() for n in ("lexical", "dense")}
    assert [x.id for x in before["dense"] if x.id_query == 2][0] == "2" and {x.id for x in before["lexical"] if x.id_query == 1} == {"1", "2"}
    r.build(f"file://{tmp_path}/index")
    assert {n: r.open(f"file://{tmp_path}/index").search(n, q).orderBy("id_query", "rank").collect() for n in ("lexical", "dense")} == before
    pool = r.pool(["bm25", "dense"], q, 2)
    assert {x.profile: x.pool_pairs for x in retrieval.pool_summary(retrieval.memberships(pool)).collect()} == {"bm25": pool.count(), "dense": pool.count()}
    with pytest.raises(ContractError):
        r.add("lexical", T.Analyzer())
    with pytest.raises(ContractError):
        r.search("none", q)


def test_analyzer(spark):
    a = T.Analyzer(accents=False, numbers=False, stopwords=T.read_stopwords("The # article\n\n# none\nof"), least=2)
    assert column(spark, ["The &eacute;t&eacute; OF 2020 <b>x1</b> y"], a) == [["ete", "x1"]]


def test_collection_reduction(spark):
    res = spark.createDataFrame([("m1", "list", "0", 0, '{"a":1}', "a.csv", "p1"), ("m1", "list", "1", 1, '{"b":2}', "b.pdf", "p2"), ("m2", "dict", 'k"1', 0, "{}", "c.tsv", ""), ("m3", "dict", "z", 0, "{}", "d.csv", "p4")], "meta_file string, container string, res_key string, ord int, raw string, file_name string, path string")
    rows = spark.createDataFrame([(f, i) for f in ("a.csv", "b.pdf", "c.tsv", "d.csv") for i in range(30)], "file_name string, row_no int")
    left, kept, counts = collection.reduced_collection(res, rows, spark.createDataFrame([("m3",)], "meta_file string"), spark.createDataFrame([("nothing",)], "name string"), 4)
    assert {r.file_name for r in left.collect()} == {"a.csv", "c.tsv"} and kept.count() == 8
    assert {(r.file_name, r.source_rows, r.sampled_rows) for r in counts.collect()} == {("a.csv", 30, 4), ("c.tsv", 30, 4)}
    built = {r.meta_file: json.loads(r.resources) for r in collection.rebuilt_resources(res).collect()}
    assert built == {"m1": [{"a": 1}, {"b": 2}], "m2": {'k"1': {}}, "m3": {"z": {}}}
    assert {r.meta_file: r.path for r in collection.first_with_path(res).collect()} == {"m1": "p1", "m3": "p4"}
    records = spark.createDataFrame([("m3", "t", "d")], "meta_file string, title string, description string")
    collection.prepared_contract(records, res)
    with pytest.raises(ContractError):
        collection.prepared_contract(records.withColumn("meta_file", F.lit("m1")), res)


def test_hit_contract(spark):
    hits = spark.createDataFrame([(1, "a", "t", 1.0)], "id_query int, id string, title string, score double")
    contracts.checked_hits(hits, ["title"])
    for bad in (hits.withColumn("score", F.lit(float("nan"))), hits.withColumn("id", F.lit(" ")), hits.union(hits), hits.withColumn("title", F.lit(None))):
        with pytest.raises(ContractError):
            contracts.checked_hits(bad, ["title"])
    with pytest.raises(ContractError):
        contracts.used_at_least_once(spark.createDataFrame([("a",)], "judge string"), spark.createDataFrame([("a",), ("b",)], "judge string"))


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, 1), (1, 3)], "g int, rank int")
    assert contracts.contiguous_ranks(df, ["g"]).first().ok is False and contracts.contiguous_ranks(df, ["g"], strict=False).first().ok is True
    with pytest.raises(ContractError):
        contracts.unique(df, "g")
    with pytest.raises(ContractError):
        contracts.same_keys(df, df.limit(1), ["g", "rank"])
    with pytest.raises(ContractError):
        contracts.not_empty(df.limit(0), "empty")
    q = lambda *rows: spark.createDataFrame(rows, "ID string, QUERY string")
    assert contracts.checked_queries(q((" 07", " a "))).first().id_query == 7
    for bad in (("0", "a"), ("x", "a"), ("1", " ")):
        with pytest.raises(ContractError):
            contracts.checked_queries(q(bad))
    with pytest.raises(ContractError):
        contracts.checked_queries(q(("1", "a"), ("01", "b")))


def test_texts(spark):
    assert column(spark, [" a \x1c b\r\nc ", None], T.squeezed) == ["a b c", ""]
    assert column(spark, ["¿Qué  tal ?!?? ..... hola ,mundo 3.5 #  ##x 20°C a(b"], T.query_text) == ["¿qué tal?!... hola, mundo 3.5 ##x 20° c a (b"]
    assert column(spark, ["<p>Hi &amp; b</p> http://x.y/z www.a.b Ünï"], T.lexical_tokens) == [["hi", "ünï"]]
    assert column(spark, ["TRUE ", "False", "yes", "1", None], T.strict_bool) == [True, False, None, None, None]
    assert column(spark, ['```json\n{"a": [1, 2,], }\n```', "no", 'x {"b":1} y', None, ""], T.cleaned_output) == ['{"a": [1, 2]}', "no", '{"b":1}', "", ""]
    assert column(spark, ["a", "é/1"], T.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ("a", "é/1")]
    assert column(spark, [["a b", " ", "c"], ['q"']], lambda c: T.header_line(c, F.lit(";")), "array<string>") == ['"a b";c', '"q""'.replace('""', '""')]
    assert column(spark, ['{"b": 1, "a": {"d": 1, "c": 2}}', None, "x"], T.canonical_json) == ['{"a": {"c": 2, "d": 1}, "b": 1}', "{}", "{}"]


@pytest.mark.parametrize(
    "value,want",
    [("t ", "t"), ({"en": "e", "es": "s"}, "s"), ({"fr": "f", "en": ""}, "f"), ({"language": "en", "value": "v"}, "v"), ([{"language": "en", "value": "e"}, {"language": "es", "value": "s"}], "s"), (["", "x"], "x"), ({"es": [{"value": "q"}]}, "q"), (None, ""), (3, ""), ({"language": "es", "value": ""}, "es")],
)
def test_multilingual(spark, value, want):
    assert column(spark, [json.dumps(value)], T.multilingual) == [want]


def test_collection(spark):
    rows = [("m1", "h", "latin-1", ";", "b", 0), ("m1", "h", "UTF-8", ",", "c", 1), ("m1", "h", "utf-8", ";", "d", 2), ("m1", "h", "utf-8", ";", "a", 3), ("m2", None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "meta string, hash string, encoding string, delimiter string, path string, ord int")
    assert [r.path for r in collection.preferred(df, ["meta", "hash"]).filter("kept").orderBy("meta").collect()] == ["a", None]
    files = [(b"a;b\r\n 1 ;\xe9\n", "latin-1", ";"), ("a;b\n1;é\n".encode(), "utf-8", ";"), (b"x", "utf-8", None), (None, "utf-8", ";")]
    got = [r[0] for r in spark.createDataFrame(files, "c binary, e string, d string").select(collection.table_md5("c", "e", "d")).collect()]
    assert got[0] == got[1] and got[2:] == [None, None]
    t = spark.createDataFrame([(b"h1,h2\n1,2\n3\n", None, ",", True)], "c binary, e string, d string, f boolean").select(collection.table_texts("c", "e", "d", "f").alias("t")).first().t
    assert (t.rows, t.columns) == ("1,2\n3\n", "h1 1 3\nh2 2\n")
    assert column(spark, [" \n\na\r\nb\rc \n", ""], collection.nonblank_lines) == [3, 0]
    ex = spark.createDataFrame([("x",)], "name string")
    res = spark.createDataFrame([("x", "p"), ("q", "x"), ("a", "b")], "n1 string, n2 string")
    assert [r.n1 for r in collection.without(res, ex, ["n1", "n2"]).collect()] == ["a"]


def test_row_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("row"))
    a, b = (collection.sampled_rows(df.repartition(n), "g", "row", 20).orderBy("g", "row").collect() for n in (1, 9))
    assert a == b and len(a) == 140


def test_exact_sample_is_pythons(spark):
    keys = [f"{i}||d" for i in range(50)]
    got = [r.pair_key for r in sampling.exact_sample(spark.createDataFrame([(k,) for k in keys], "pair_key string"), 10, 1).orderBy("order").collect()]
    assert got == random.Random(1).sample(sorted(keys), 10)
    with pytest.raises(ContractError):
        sampling.exact_sample(spark.createDataFrame([("a",)], "pair_key string"), 2, 1)


def test_exact_sample_has_no_cap_and_fetches_ranks_only(spark, monkeypatch):
    """Repeated keys over several partitions, with the former cap below their number."""
    monkeypatch.setattr(sampling, "EXACT_KEYS", 10, raising=False)
    keys = [f"{i % 700}||é{i % 3}" for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "pair_key string").repartition(7)
    got = [r.pair_key for r in sampling.exact_sample(df, 40, 3).orderBy("order").collect()]
    assert got == random.Random(3).sample(sorted(keys), 40)
    assert sampling.exact_sample(df.limit(0), 0, 3).count() == 0


def test_judgments(spark):
    good = {"main_resource": "a", "scope": None, "supporting_field": "title", "quote": "q", "reason": " subtype "}
    raws = [json.dumps(good), "{bad", "[1]", json.dumps(good | {"reason": "x"}), json.dumps(good | {"quote": " "}), json.dumps(good | {"supporting_field": "z"}), json.dumps(good | {"reason": "generic"}), json.dumps({"reason": "generic", "main_resource": "m"}), json.dumps({k: v for k, v in good.items() if k != "quote"}), None]
    got = column(spark, raws, judge.parsed)
    assert [g.error for g in got] == [None, "invalid_json", "invalid_schema", "invalid_schema", "invalid_schema", "invalid_schema", None, None, "invalid_schema", "invalid_json"]
    assert (got[0].reason, got[0].relevance, got[0].quote) == ("subtype", True, "q") and (got[6].relevance, got[6].quote, got[6].supporting_field) == (False, None, None)


def test_judging_retries_and_resumes(spark):
    def flaky(prompts):
        flaky.calls = getattr(flaky, "calls", 0) + 1
        return ["{}" if flaky.calls > 2 else "oops" for _ in prompts]

    pairs = spark.createDataFrame([(1, "a"), (1, "b")], "id_query int, id_dataset string").withColumn("prompt", F.lit("p")).coalesce(1)
    got = judge.judged(pairs, {"m": flaky, "never": lambda ps: ["no"] * len(ps)}, attempts=4).collect()
    assert {(r.model, r.attempts, r.raw) for r in got} == {("m", 3, "{}"), ("never", 4, "no")}
    done = spark.createDataFrame([(1, "a", "m", None), (1, "b", "m", "invalid_json")], "id_query int, id_dataset string, model string, error string")
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    assert {(r.id_dataset, r.model) for r in judge.pending(pairs, models, done).collect()} == {("b", "m"), ("a", "n"), ("b", "n")}
    with pytest.raises(ContractError):
        judge.consistent(spark.createDataFrame([("generic", None, True)], "reason string, error string, relevance boolean"))
    with pytest.raises(ContractError):
        judge.unchanged_evidence(done.withColumn("t", F.lit("old")), pairs.withColumn("t", F.lit("new")), ["t"])


def test_annotation_stream(spark, tmp_path):
    schema = "id_query int, id_dataset string, model string, reason string, error string"
    source, table = f"{tmp_path}/in", f"file://{tmp_path}/table"
    for k, rows in enumerate([[(1, "a", "m", None, "bad"), (1, "b", "m", "generic", None)], [(1, "a", "m", "subtype", None), (1, "b", "m", None, "bad")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        resume.annotation_stream(stream, table, f"file://{tmp_path}/check").awaitTermination(120)
        assert resume.versions(spark, table) == list(range(1, k + 2))
    got = {r.id_dataset: (r.reason, r.error) for r in resume.current(spark, table).collect()}
    assert got == {"a": ("subtype", None), "b": ("generic", None)}


def test_assembly_and_round_trip(spark, tmp_path):
    keys = "id_query int, id_dataset string"
    pool = spark.createDataFrame([(1, "a"), (1, "b")], keys)
    ann = spark.createDataFrame([(1, d, j, "generic", False, None) for d in "ab" for j in ("j1", "j2")], keys + ", judge string, reason string, relevance boolean, error string")
    humans = spark.createDataFrame([(1, "a", f"h{i}", i < 2, "subtype" if i < 2 else "generic") for i in range(3)], keys + ", annotator string, relevance boolean, reason string")
    bench = assemble.assembled(pool, ann, "j1", assemble.audits(humans, 3), ["j1", "j2"])
    rows = {r.id_dataset: r for r in bench.collect()}
    assert rows["a"].human_audit.majority_relevance is True and rows["a"].human_audit.majority_reason == "subtype" and rows["b"].human_audit is None
    s = assemble.release_summary(bench).first()
    assert (s.pairs, s.queries, s.relevant, s.non_relevant, s.missing, s.audited, s.audit_relevant) == (2, 1, 0, 2, 0, 1, 1)
    path = f"file://{tmp_path}/bench"
    writers.write_jsonl(bench, path)
    back = spark.read.schema(bench.schema).json(path)
    assemble.verified(bench, back, ["annotations", "default_relevance", "human_audit"])
    with pytest.raises(ContractError):
        writers.write_jsonl(bench, path)
    with pytest.raises(ContractError):
        assemble.verified(bench, back.limit(1), ["annotations"])
    with pytest.raises(Exception, match="pairs without all annotators"):
        assemble.audits(humans.limit(2), 3).collect()
    with pytest.raises(Exception, match="no valid default judgment"):
        assemble.assembled(pool, ann.filter("id_dataset = 'a'"), "j1").collect()
    with pytest.raises(Exception, match="duplicates of a pair"):
        assemble.assembled(pool.unionByName(pool), ann, "j1").count()
    with pytest.raises(Exception, match="unexpected judges"):
        assemble.assembled(pool, ann, "j1", None, ["j1"]).select("id_query").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes("ID\tQUERY\tmore, x\r\n1\tuno, dos\t3\r\n2\ttres\t4\r\n".encode())
    assert [(r.id_query, r.query) for r in readers.read_queries(spark, f"{tmp_path}/q.csv").orderBy("id_query").collect()] == [(1, "uno, dos"), (2, "tres")]
    pool = tmp_path / "pool"
    pool.mkdir()
    hit = {f: f for f in readers.FIELDS} | {"retrieval": {"lex": {"rank": 1, "score": 2.5}}, "annotations": {"m": {"reason": "generic", "relevance": False}, "n": {"error": "invalid_json", "raw_output": "x"}}}
    for n in (10, 2):
        (pool / f"query_{n}.json").write_text(json.dumps({"id_query": n, "query": "q", "hits": [hit | {"id": f"d{k}"} for k in range(2)]}, indent=1))
    rows = readers.read_annotated(spark, str(pool))
    assert {(r.pair_key, r.result_index, r.retrieval["lex"].score) for r in rows.collect()} == {(f"{n}||d{k}", k, 2.5) for n in (2, 10) for k in (0, 1)}
    assert rows.select(F.min(contracts.valid_provenance(F.col("retrieval")))).first()[0] is True
    long = judge.consistent(readers.long_annotations(rows))
    assert {(r.judge, r.relevance) for r in long.collect()} == {("m", False), ("n", None)}
    (pool / "query_x.json").write_text("{}")
    with pytest.raises(ContractError):
        readers.read_pool(spark, str(pool))
    (tmp_path / "f.jsonl").write_text('{"pair_key": "1||a"}\n\n{"id_query": 2, "id_dataset": "b"}\n')
    assert {tuple(r) for r in readers.read_pair_filter(spark, f"{tmp_path}/f.jsonl").collect()} == {("1", "a"), ("2", "b")}
    (tmp_path / "g.jsonl").write_text('{"pair_key": "1||a", "id_query": 2, "id_dataset": "a"}\n')
    with pytest.raises(ContractError):
        readers.read_pair_filter(spark, f"{tmp_path}/g.jsonl")
    (tmp_path / "h1.csv").write_text("pair_key,id_query,id_dataset,reason,relevance,notes\n1||a,1,a,generic,False,\n")
    h = readers.read_humans(spark, {"h1": f"{tmp_path}/h1.csv"}).first()
    assert h.relevance is False and h.notes is None and h.annotator == "h1"
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "meta_b.json").write_text(json.dumps({"resources": {"k": {"path": "p", "fileName": "f.csv", "schema": {"fields": [{"name": "x"}, {"name": "y"}]}}, "bad": 3}}))
    (meta / "Meta_a.json").write_text(json.dumps({"resources": [{"path": "q"}, "no"]}))
    (meta / "other.json").write_text("{}")
    m = readers.read_metadata(spark, str(meta))
    assert [(r.meta_file, r.ord) for r in m.orderBy("ord").collect()] == [("Meta_a.json", 0), ("meta_b.json", 1)]
    got = {(r.container, r.res_key, r.path, tuple(r.field_names or ())) for r in readers.resources_of(m).collect()}
    assert got == {("dict", "k", "p", ("x", "y")), ("list", "0", "q", ())}
    assert readers.read_files(spark, f"{meta}/other.json").first().md5 == "99914b932bd37a50b983c5e7c90ae93b"
    (tmp_path / "s.csv").write_text("pair_key\nb\na\n")
    assert [(r.pair_key, r.order) for r in readers.read_sample(spark, f"{tmp_path}/s.csv").orderBy("order").collect()] == [("b", 1), ("a", 2)]


def test_csv_writer(spark, tmp_path):
    df = spark.createDataFrame([("a", True, None), ("b", False, 'q"x')], "k string, b boolean, s string")
    writers.write_csv(df, f"file://{tmp_path}/out", single=True)
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines == ["k,b,s", "a,True,", 'b,False,"q""x"']


def test_settings():
    s = Settings.from_json(json.dumps({"judges": ["a", "b", "c"], "default_judge": "a"}))
    assert s.judges == ("a", "b", "c") and s.relevance == RELEVANCE
    for bad in ({"judges": ["a", "a"]}, {"panel_size": 2}, {"pool_depth": True}, {"confidence": 1.5}, {"default_judge": "z"}, {"unknown": 1}):
        with pytest.raises(ContractError):
            Settings.from_json(json.dumps(bad))
    assert config.checked_registry({"m ": {"model": "x", "platform": "Ollama local"}}) == {"m": "ollama"}
    with pytest.raises(ContractError):
        config.checked_registry({"m": {"platform": "openai", "zone": 1}})
    assert config.parse_named("a=u, b=v") == [("a", "u"), ("b", "v")]
    for bad in ("a", "a=1,a=2", ""):
        with pytest.raises(ContractError):
            config.parse_named(bad)
    assert config.same_run({"a": {"max_attempts": 1, "b": 2}}, {"a": {"b": 2, "max_attempts": 9}}) and not config.same_run({"a": 1}, {"a": 2})


def test_readers_of_labels_raise(spark, tmp_path):
    def csv(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    head = "pair_key,combination,valid_votes,aggregated_relevance\n"
    fine = csv("a.csv", head + "1||a,x,3,True\n1||b,x,2,\n")
    assert readers.read_aggregation(spark, fine).count() == 2
    for k, bad in enumerate(("1||a,x,4,True\n", "1||a,x,3,\n", "1||a,x,2,True\n", "1||a,x,,\n", "1||a,x,3,yes\n", "1||a,x,3,True\n1||a,x,3,True\n")):
        with pytest.raises(ContractError):
            readers.read_aggregation(spark, csv(f"bad{k}.csv", head + bad))
    with pytest.raises(ContractError, match="lacks"):
        readers.read_aggregation(spark, csv("c.csv", "pair_key\n1\n"))
    sample = spark.createDataFrame([("1||a",)], "pair_key string")
    with pytest.raises(ContractError, match="unexpected"):
        readers.read_aggregation(spark, fine, sample)
    assert readers.read_majority(spark, csv("m.csv", "pair_key,majority_relevance\n1||a,False\n"), sample).first().majority_relevance is False
    for k, bad in enumerate(("1||a,\n", "1||a,maybe\n", "1||a,true\n1||a,true\n", "1||b,true\n")):
        with pytest.raises(ContractError):
            readers.read_majority(spark, csv(f"m{k}.csv", "pair_key,majority_relevance\n" + bad), sample)


def test_validated_benchmark_raises(spark):
    make = lambda rows: spark.createDataFrame(rows, "id_query int, id_dataset string, default_relevance boolean, default_relevance_source string, annotations map<string,string>")
    fine = [(1, "a", True, "j", {}), (1, "b", False, "j", {})]
    assert readers.validated_benchmark(make(fine), "j").count() == 2
    for bad in ([(1, "a", None, "j", {})], [(1, "a", True, "k", {})], [(1, " ", True, "j", {})], [*fine, fine[0]], [(2, "c", False, "j", {}), *fine]):
        with pytest.raises(ContractError):
            readers.validated_benchmark(make(bad), "j")
    with pytest.raises(ContractError, match="lacks"):
        readers.validated_benchmark(make(fine).drop("annotations"), "j")


def test_provenance_guards_a_resume():
    old = config.provenance(config.Settings(judges=("a",)), {"queries": "q", "pool": "p"}, {"m": {"platform": "ollama"}})
    config.resumable(old, config.provenance(config.Settings(judges=("a",), attempts=9), {"queries": "q", "pool": "p"}, {"m": {"platform": "ollama"}}))
    for settings, inputs, models in ((config.Settings(judges=("b",)), {"queries": "q", "pool": "p"}, {"m": {"platform": "ollama"}}), (config.Settings(judges=("a",)), {"queries": "q2", "pool": "p"}, {"m": {"platform": "ollama"}}), (config.Settings(judges=("a",)), {"queries": "q", "pool": "p"}, {"m": {"platform": "openai"}})):
        with pytest.raises(ContractError, match="differ"):
            config.resumable(old, config.provenance(settings, inputs, models))
    with pytest.raises(ContractError):
        config.resumable(None, old)


def test_provenance_is_kept(spark, tmp_path):
    path = f"file://{tmp_path}/run.json"
    one, two = (config.provenance(config.Settings(judges=(j,)), {"queries": "q"}) for j in ("a", "b"))
    with pytest.raises(ContractError):
        writers.guarded_run(spark, path, one, has_results=True)
    assert writers.load_json(spark, path) is None
    writers.guarded_run(spark, path, one, has_results=False)
    writers.guarded_run(spark, path, one, has_results=True)
    assert writers.load_json(spark, path) == one
    with pytest.raises(ContractError, match="settings differ"):
        writers.guarded_run(spark, path, two, has_results=True)
    with pytest.raises(ContractError):
        writers.save_json(spark, path, two)
    docs = spark.createDataFrame([(1, "x")], "id_query int, query string")
    with pytest.raises(ContractError, match="missing"):
        writers.write_query_documents(docs, f"file://{tmp_path}/docs", expected=spark.createDataFrame([(1,), (2,)], "id_query int"))
    writers.write_query_documents(docs, f"file://{tmp_path}/docs", expected=docs.select("id_query"))
    assert [p.name for p in (tmp_path / "docs").glob("*.json")] == ["query_1.json"]


def test_payload_falls_back(spark):
    df = spark.createDataFrame([(" a ", "x", None), ("", "b", "c"), (None, None, None)], "title string, name string, other string")
    got = retrieval.payload(df, ("title", "none"), {"title": ("name", "other")}).select("title", "none").collect()
    assert [tuple(r) for r in got] == [("a", ""), ("b", ""), ("", "")]


def test_intervals_against_plain_python(spark):
    """Kappas, agreement and their bounds for drawn weights, against sums in Python."""
    r = random.Random(4)
    labels = {(i, h): r.random() < 0.4 + 0.2 * (i % 3) for i in range(40) for h in ("h1", "h2", "h3") if (i, h) != (3, "h2")}
    weights = [(it, i, r.randrange(3)) for it in range(25) for i in range(40)]
    df = spark.createDataFrame([(i, h, x) for (i, h), x in labels.items()], "item int, rater string, label boolean")
    w = spark.createDataFrame(weights, "iteration int, item int, w int")

    def kappa(pairs):
        n, pa, pb, pab = (sum(w for _, _, w in pairs), sum(w for a, _, w in pairs if a), sum(w for _, b, w in pairs if b), sum(w for a, b, w in pairs if a and b))
        po, pe = (n - pa - pb + 2 * pab) / n, (pa * pb + (n - pa) * (n - pb)) / (n * n)
        return (po - pe) / (1 - pe)

    by = {}
    for it, i, x in weights:
        by.setdefault(it, []).append((i, x))
    want = sorted(kappa([(labels[i, "h1"], labels[i, "h3"], x) for i, x in rows]) for rows in by.values())
    got = agreement.human_intervals(df, ["h1", "h2", "h3"], w).first()
    at = lambda q: (lambda p: want[int(p)] + (p - int(p)) * (want[min(int(p) + 1, 24)] - want[int(p)]))(q * 24)
    assert abs(got.cohen_kappa_h1_h3_ci_low - at(0.025)) < 1e-9 and abs(got.cohen_kappa_h1_h3_ci_high - at(0.975)) < 1e-9 and got.iterations == 25
    one = spark.createDataFrame([(i, "s", labels[i, "h1"]) for i in range(40)], "item int, source string, label boolean")
    row = agreement.kappas_by_rater(one, df, ["h1", "h2", "h3"]).first()
    assert abs(row.kappa_h1 - 1) < 1e-9 and abs(row.mean_kappa - (row.kappa_h1 + row.kappa_h2 + row.kappa_h3) / 3) < 1e-9
    flat = agreement.rater_intervals(one, df, ["h1", "h3"], w).first()
    assert flat.kappa_h1_ci_low == flat.kappa_h1_ci_high == 1 and abs(flat.kappa_h3_ci_low - at(0.025)) < 1e-9


def _drawn(spark, labels, category):
    """Labels of three raters, weights by a rule, and the same weights as a table; an item is drawn from twice, some never."""
    df = spark.createDataFrame(labels, f"item long, rater string, {category}")
    items = spark.createDataFrame([(i,) for i in [*range(35), 7, 99]], "item long")
    rule = agreement.Weights(items, 20, lambda it, i: (it * 5 + i * 11) % 4)
    return df, rule, spark.createDataFrame([(it, i, (it * 5 + i * 11) % 4) for it in range(20) for (i,) in items.collect()], "iteration int, item long, w long")


def _apart(df):
    """Whether rows by item and iteration are made after all joins, where they are summed."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return max(i for i, x in enumerate(lines) if "Generate explode" in x and "iteration" in x) < min(i for i, x in enumerate(lines) if "Join" in x)


def test_label_intervals_by_a_rule(spark):
    """weights by a rule give what a table of them gives, and no row for an item and iteration is joined or sorted."""
    r = random.Random(5)
    df, rule, weights = _drawn(spark, [(i, h, r.choice([True, False, False, None])) for i in range(40) for h in ("h1", "h2", "h3")], "label boolean")
    one = df.filter("rater = 'h1'").select("item", F.lit("s").alias("source"), (F.col("label") | (F.col("item") % 4 == 0)).alias("label"))
    both = one.join(df.filter("rater = 'h2'").select("item", F.col("label").alias("truth")), "item").withColumnRenamed("item", "pos")
    pos = agreement.Weights(rule.items.withColumnRenamed("item", "pos"), rule.iterations, rule.of)
    for f in (lambda w, _: agreement.human_intervals(df, ["h1", "h2", "h3"], w), lambda w, _: agreement.rater_intervals(one, df, ["h2", "h3"], w), lambda _, w: agreement.bootstrap_intervals(both, w)):
        got, want = f(rule, pos), f(weights, weights.withColumnRenamed("item", "pos")).first()
        assert _apart(got)
        assert all(x == y if not isinstance(x, float) else abs(x - y) < 1e-12 for x, y in zip(got.first(), want, strict=True)) and want.iterations == 20


def test_reason_intervals_by_a_rule(spark):
    """the same for reasons."""
    r = random.Random(6)
    df, rule, weights = _drawn(spark, [(i, h, r.choice(["a", "a", "b", None])) for i in range(40) for h in ("h1", "h2", "h3")], "reason string")
    got, want = (agreement.reason_intervals(df, 3, ["a", "b"], w) for w in (rule, weights))
    assert _apart(got) and all(abs(x - y) < 1e-12 for x, y in zip(got.first(), want.first(), strict=True))


def benchmark_config():
    return {
        "benchmark": {"default_relevance_source": "a"},
        "collection": {"filtering": {"require_title": True, "require_description": True, "minimum_data_rows": 1}, "resource_selection": {"resources_per_dataset": 1}, "content_sampling": {"maximum_rows": 20, "random_seed": 0, "file_order": "sorted"}},
        "candidate_pool": {"pooling_depth": 50, "profiles": {"bm25": {}}},
        "llm_annotation": {
            "models": ["a", "b", "c"], "few_shots": True, "few_shot_examples": 2, "input_components": ["query", "title"], "content_character_limit": 0, "maximum_attempts": 6, "prompt_blueprint": "tabular",
            "reason_labels": ["x", "y"], "relevance_mapping": {"x": True, "y": False}, "positive_evidence_fields": ["title"], "invalid_output_policy": "missing", "negative_evidence_normalization": {"supporting_field": None, "quote": None},
        },
        "human_audit": {"sample_size": 300, "sample_seed": 1, "annotators": 3, "sampling": "simple_random_without_replacement", "human_majority": {"binary_rule": "2_out_of_3"}},
        "judge_aggregation": {"judge_combination_size": 3, "number_of_combinations": 1, "aggregation_rule": "2_out_of_3_majority_vote", "require_all_three_valid_judgments": True, "missing_judgment_policy": "missing"},
        "evaluation": {"bootstrap": {"confidence_level": 0.95, "method": "percentile", "iterations": 10_000, "seed": 0, "resampling_unit": "query_dataset_pair", "paired": True}},
    }


def test_benchmark_configuration():
    s = config.benchmark_settings(benchmark_config())
    assert s.judges == ("a", "b", "c") and s.default_judge == "a" and s.bootstrap_iterations == 10_000 and s.relevance == {"x": True, "y": False} and s.profiles == ("bm25",)
    bad = [("llm_annotation.few_shot_examples", 0), ("llm_annotation.input_components", ["title"]), ("llm_annotation.relevance_mapping", {"x": True}), ("llm_annotation.relevance_mapping", {"x": True, "y": 1}), ("llm_annotation.positive_evidence_fields", ["query"]),
           ("llm_annotation.positive_evidence_fields", ["header"]), ("llm_annotation.negative_evidence_normalization", {"quote": None}), ("llm_annotation.invalid_output_policy", "drop"), ("judge_aggregation.judge_combination_size", 5), ("judge_aggregation.number_of_combinations", 10),
           ("evaluation.bootstrap.confidence_level", 0.9), ("evaluation.bootstrap.paired", False), ("benchmark.default_relevance_source", "z"), ("collection.content_sampling.file_order", "any"), ("candidate_pool", None), ("human_audit.sample_size", True), ("llm_annotation.models", ["a", "a"])]
    for path, value in bad:
        c = benchmark_config()
        at = c
        *way, last = path.split(".")
        for k in way:
            at = at[k]
        at[last] = value
        with pytest.raises(ContractError):
            config.benchmark_settings(c)


def test_small_operators(spark, tmp_path):
    assert [T.singular(w) for w in ("ponies", "eies", "boxes", "shoes", "glass", "bus", "cats", "s", "is")] == ["pony", "eie", "boxe", "shoe", "glass", "bus", "cat", "s", "is"]
    with pytest.raises(ContractError):
        judge.few_shots("tabular", [], 1)
    with pytest.raises(ContractError):
        judge.blueprint_part("tabular", "poem")
    with pytest.raises(ContractError):
        judge.dispatched({"m": {"platform": "vertex"}}, {})
    done = spark.createDataFrame([("a", None), ("b", "x")], "model string, error string")
    assert judge.has_valid(done, "a") and not judge.has_valid(done, "b")
    (tmp_path / "x.txt").write_text("x")
    assert writers.copied(spark, f"file://{tmp_path}/x.txt", f"file://{tmp_path}/y.txt") and (tmp_path / "y.txt").read_text() == "x"
    assert not writers.copied(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/z")
    rows = writers.in_query_order(spark.createDataFrame([("10", "a"), ("9", "b"), ("9", "B")], "id_query string, id_dataset string")).collect()
    assert [(r.id_query, r.id_dataset) for r in rows] == [("9", "B"), ("9", "b"), ("10", "a")]
    with pytest.raises(ContractError, match="missing"):
        (tmp_path / "h.csv").write_text("pair_key,id_query,id_dataset,reason,relevance\n1||a,1,a,x,true\n")
        readers.read_humans(spark, {"h": f"file://{tmp_path}/h.csv"}, spark.createDataFrame([("1||a",), ("1||b",)], "pair_key string"))
