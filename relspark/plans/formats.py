"""Queries over the engine's file formats and single operators: what is written is read back through the readers, and
SQL says what must come out. Files go to a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collection, contracts, judge, retrieval, votes
from ..sources import readers, writers
from ..streaming import resume
from .queries import ASSEMBLED, JUDGES, PANELS, POOL, REASONS, TRUTH, _benchmark, humans_of, pairs_of, profile_ranks, query, release_summary, table, votes_of, with_base

CLEAN = "trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))"


def _clean(x):
    return F.trim(F.regexp_replace(x, "[^a-zA-Z0-9]+", " "))


@query(f"SELECT CAST(item_id + 1 AS INTEGER) AS id_query, {CLEAN} AS query FROM benchmark")
def read_query_file(spark, sf):
    """A tab-separated query table."""
    path = writers.workspace(spark, "queries")
    writers.write_csv(table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("ID"), _clean(F.col("text")).alias("QUERY")), path, sep="\t")
    return readers.read_queries(spark, path)


@query("WITH " + POOL + """
SELECT CAST(id_query AS INTEGER) AS id_query, 'd' || id AS id_dataset, id_query || '||d' || id AS pair_key, CAST(count(*) AS INTEGER) AS n_profiles, min(rank)::INTEGER AS best_rank,
  CAST(row_number() OVER (PARTITION BY id_query ORDER BY min(po), arg_min(rank, po), id) - 1 AS INTEGER) AS result_index FROM top GROUP BY id_query, id""")
def read_pool_documents(spark, sf):
    """A pool as one JSON document a query, query_<n>.json."""
    pool = retrieval.pooled(profile_ranks(spark, sf), 10)
    fields = [F.concat(F.lit("d"), F.col("id")).alias("id"), *[F.lit(f).alias(f) for f in readers.FIELDS[1:]], "retrieval"]
    hits = F.transform(F.array_sort(F.collect_list(F.struct("result_index", F.struct(*fields).alias("hit"))), lambda a, b: a["result_index"] - b["result_index"]), lambda x: x["hit"])
    path = writers.workspace(spark, "pool")
    writers.write_query_documents(pool.groupBy("id_query").agg(hits.alias("hits")).select("id_query", F.lit("need").alias("query"), "hits"), path)
    best = F.array_min(F.transform(F.map_values("retrieval"), lambda r: r["rank"]))
    return readers.read_pool(spark, path).select("id_query", "id_dataset", "pair_key", F.size("retrieval").alias("n_profiles"), best.alias("best_rank"), "result_index")


@query(with_base("SELECT CAST(id_query AS INTEGER) AS id_query, id_dataset, judge, reason, relevance, CASE WHEN relevance IS NULL THEN 'invalid_json' END AS error FROM v"))
def read_annotated_documents(spark, sf):
    """Judged pairs as one JSON document a query; annotations in long form, their relevance derived again."""
    v = votes_of(spark, sf)
    note = F.struct("reason", "relevance", F.when(F.col("relevance").isNull(), "invalid_json").alias("error"))
    own = v.groupBy("id_query", "id_dataset").agg(F.map_from_entries(F.collect_list(F.struct("judge", note))).alias("annotations"))
    hit = F.struct(F.col("id_dataset").alias("id"), F.lit("t").alias("title"), F.create_map(F.lit("lexical"), F.struct(F.lit(1).alias("rank"), F.lit(1.0).alias("score"))).alias("retrieval"), "annotations")
    path = writers.workspace(spark, "annotated")
    writers.write_query_documents(own.groupBy("id_query").agg(F.collect_list(hit).alias("hits")).select("id_query", F.lit("need").alias("query"), "hits"), path)
    long = readers.long_annotations(readers.read_annotated(spark, path))
    return judge.consistent(long).select("id_query", "id_dataset", "judge", "reason", "relevance", "error")


@query(with_base("SELECT CAST(id_query AS VARCHAR) AS id_query, id_dataset FROM pairs"))
def read_pair_filter_file(spark, sf):
    p = pairs_of(spark, sf)
    path = writers.workspace(spark, "filter")
    writers.write_csv(p.select(T.pair_key(F.col("id_query"), F.col("id_dataset")).alias("pair_key"), "id_query", "id_dataset"), path)
    return readers.read_pair_filter(spark, path)


@query(with_base("SELECT annotator, id_query || '||' || id_dataset AS pair_key, reason, relevance FROM h"))
def read_human_files(spark, sf):
    """A CSV for each annotator; booleans are strict."""
    h = humans_of(spark, sf).withColumn("pair_key", T.pair_key(F.col("id_query"), F.col("id_dataset")))
    paths = {}
    for name in ("h1", "h2", "h3"):
        paths[name] = writers.workspace(spark, name)
        writers.write_csv(h.filter(F.col("annotator") == name).drop("annotator", "doc_id"), paths[name])
    return readers.read_humans(spark, paths).select("annotator", "pair_key", "reason", "relevance")


@query(with_base("SELECT id_query || '||' || id_dataset AS pair_key, combination, valid_votes, aggregated_relevance FROM p", PANELS))
def read_aggregation_file(spark, sf):
    """The table of panels as CSV: votes in 0 to 3, a label if and only if there are three, every pair of the sample covered."""
    panels = votes.panels(votes_of(spark, sf), JUDGES).withColumn("pair_key", T.pair_key(F.col("id_query"), F.col("id_dataset")))
    path = writers.workspace(spark, "panels")
    writers.write_csv(panels.select("pair_key", "combination", "valid_votes", "aggregated_relevance"), path)
    out = readers.read_aggregation(spark, path, panels.select("pair_key").distinct())
    return out.select("pair_key", "combination", "valid_votes", "aggregated_relevance")


@query(with_base("SELECT v.id_query || '||' || v.id_dataset AS pair_key, truth AS majority_relevance FROM t JOIN pairs v USING (id_dataset)", TRUTH))
def read_majority_file(spark, sf):
    """The audited majorities as CSV, each pair once."""
    h = humans_of(spark, sf)
    m = votes.available_majority(h).select(T.pair_key(F.col("id_query"), F.col("id_dataset")).alias("pair_key"), F.col("majority").alias("majority_relevance"))
    path = writers.workspace(spark, "majority")
    writers.write_csv(m, path)
    return readers.read_majority(spark, path, m.select("pair_key")).select("pair_key", "majority_relevance")


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS \"order\", 'd' || doc_id AS id_dataset FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def read_sample_file(spark, sf):
    """A frozen sample as JSON lines, with its order."""
    from pyspark.sql import Window

    s = table(spark, sf, "labels").select("doc_id").distinct().join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    s = s.select(F.row_number().over(Window.orderBy("doc_id")).alias("order"), F.concat(F.lit("d"), F.col("doc_id")).alias("id_dataset"))  # a sample is small
    path = writers.workspace(spark, "sample") + ".jsonl"
    writers.write_jsonl(s, path)
    return readers.read_sample(spark, path).select("order", "id_dataset")


RESOURCES = """
res AS (SELECT 'm' || doc_id AS meta_file, CASE WHEN doc_id % 2 = 0 THEN 'list' ELSE 'dict' END AS container, k, CASE WHEN doc_id % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'r' || k END AS res_key,
  '{"path":"p' || (doc_id * 3 + k) || '","fileName":"f' || k || '.csv","encoding":"utf-8","schema":{"fields":[{"name":"a"},{"name":"' || lang || '"}]}}' AS raw, doc_id, lang FROM documents, range(3) t(k))
"""


def _metadata(spark, sf):
    i, k = F.col("doc_id"), F.col("k")
    names = F.array(F.struct(F.lit("a").alias("name")), F.struct(F.col("lang").alias("name")))
    raw = F.to_json(F.struct(F.concat(F.lit("p"), i * 3 + k).alias("path"), F.concat(F.lit("f"), k, F.lit(".csv")).alias("fileName"), F.lit("utf-8").alias("encoding"), F.struct(names.alias("fields")).alias("schema")))
    rows = table(spark, sf, "documents").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", "k", raw.alias("raw"))
    parts = F.sort_array(F.collect_list(F.struct("k", "raw")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: x["raw"]), ","), F.lit("]"))
    mapped = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"r'), x["k"].cast("string"), F.lit('":'), x["raw"])), ","), F.lit("}"))
    docs = rows.groupBy("doc_id").agg(listed.alias("l"), mapped.alias("m"))
    return docs.select(F.concat(F.lit("m"), i).alias("meta_file"), F.concat(F.lit('{"title":"t","resources":'), F.when(i % 2 == 0, F.col("l")).otherwise(F.col("m")), F.lit("}")).alias("doc"))


@query("WITH " + RESOURCES + " SELECT meta_file, container, res_key, CAST(k AS INTEGER) AS ord, 'p' || (doc_id * 3 + k) AS path, 'f' || k || '.csv' AS file_name, 'utf-8' AS encoding, 'a,' || lang AS field_names FROM res")
def metadata_resources(spark, sf):
    """Lists and objects of resources of metadata records, in their order."""
    r = readers.resources_of(_metadata(spark, sf))
    return r.select("meta_file", "container", "res_key", "ord", "path", "file_name", "encoding", F.array_join("field_names", ",").alias("field_names"))


@query("WITH " + RESOURCES + """ SELECT meta_file, md5(CASE WHEN min(container) = 'list' THEN '[' || string_agg(raw, ',' ORDER BY k) || ']' ELSE '{' || string_agg('"' || res_key || '":' || raw, ',' ORDER BY k) || '}' END) AS resources_md5 FROM res WHERE (doc_id + k) % 4 <> 1 GROUP BY meta_file""")
def rebuilt_resources(spark, sf):
    """Records written anew with the resources that stay."""
    r = readers.resources_of(_metadata(spark, sf))
    doc = F.substring("meta_file", F.lit(2), F.length("meta_file")).cast("long")
    return collection.rebuilt_resources(r.filter((doc + F.col("ord")) % 4 != 1)).select("meta_file", F.md5("resources").alias("resources_md5"))


@query("""SELECT md5(text) AS text_md5, lower(trim(lang)) AS geo, count(*) AS n, min(doc_id) AS kept, array_to_string(list_sort(list(doc_id))[2:], ',') AS duplicates
FROM documents GROUP BY text, lower(trim(lang)), source HAVING count(*) > 1""")
def functional_duplicates(spark, sf):
    """Records with the same texts, coverage and multiset of file hashes, in whatever order and writing those come."""
    i = F.col("doc_id")
    geo = F.when(i % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    hashes = F.when(i % 2 == 0, F.array(F.md5("source"), F.md5("lang"))).otherwise(F.array(F.md5("lang"), F.md5("source")))
    key = collection.functional_key(F.substring_index("text", "\n", 1), F.col("text"), F.lit(None).cast("string"), geo, hashes)
    d = table(spark, sf, "documents").select("doc_id", key.alias("key"), i.alias("ord"))
    out = collection.duplicate_groups(d, ["key"], "doc_id", "ord")
    return out.select(F.md5("key.description").alias("text_md5"), "key.geo", "n", "kept", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


def _tables(spark, sf):
    """Small files: a header line and a line of values, with blanks that don't count."""
    content = F.concat(F.lit("lang;a  b\n"), F.col("lang"), F.lit(" ; x "), F.col("doc_id") % 7, F.lit("\n")).cast("binary")
    return table(spark, sf, "documents").select("doc_id", content.alias("content"), F.lit("utf-8").alias("encoding"), F.lit(";").alias("delimiter"))


@query("SELECT doc_id, md5('lang' || chr(31) || 'a b' || chr(31) || chr(30) || lang || chr(31) || 'x ' || (doc_id % 7) || chr(31) || chr(30)) AS table_md5 FROM documents")
def table_hashes(spark, sf):
    return _tables(spark, sf).select("doc_id", collection.table_md5("content", "encoding", "delimiter").alias("table_md5"))


@query("SELECT doc_id, lang || ' ; x ' || (doc_id % 7) || chr(10) AS row_text, 'lang ' || lang || chr(10) || 'a b x ' || (doc_id % 7) || chr(10) AS column_text FROM documents")
def table_contents(spark, sf):
    """A table's first rows as text, by row and by column."""
    t = _tables(spark, sf).select("doc_id", collection.table_texts("content", "encoding", "delimiter", F.lit(True)).alias("t"))
    return t.select("doc_id", F.col("t.rows").alias("row_text"), F.col("t.columns").alias("column_text"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'plain ' || doc_id WHEN 1 THEN 'uno ' || doc_id WHEN 2 THEN 'one ' || doc_id WHEN 3 THEN 'val ' || doc_id ELSE '' END AS title FROM documents")
def localized_titles(spark, sf):
    """Metadata values in their shapes: a text, texts by language, a list of values, one with a language of its own, none."""
    i, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    raw = (
        F.when(i == 0, F.concat(F.lit('" plain '), n, F.lit(' "')))
        .when(i == 1, F.concat(F.lit('{"en": "one '), n, F.lit('", "es": "uno '), n, F.lit('"}')))
        .when(i == 2, F.concat(F.lit('[{"language": "fr", "value": "un"}, {"language": "en", "value": "one '), n, F.lit('"}]')))
        .when(i == 3, F.concat(F.lit('{"language": "de", "value": "val '), n, F.lit('"}')))
        .otherwise("null")
    )
    return table(spark, sf, "documents").select("doc_id", T.multilingual(raw).alias("title"))


@query(with_base("SELECT id_query, id_dataset, model, CAST(tries AS INTEGER) AS attempts, raw FROM pairs, (VALUES ('sure', 1, '{\"reason\": \"generic\"}'), ('never', 3, 'no answer')) t(model, tries, raw)"))
def judged_pairs(spark, sf):
    """Judges as functions over batches; an unusable answer is asked for again."""
    answers = {"sure": '{"reason": "generic"}', "never": "no answer"}
    judges = {name: (lambda prompts, a=a: [a] * len(prompts)) for name, a in answers.items()}
    return judge.judged(pairs_of(spark, sf).withColumn("prompt", F.col("id_dataset")), judges, attempts=3)


@query("SELECT doc_id, doc_id % 4 = 0 AS fine FROM documents")
def provenance_contract(spark, sf):
    """Fine, of rank 0, of an infinite score, and empty."""
    i = F.col("doc_id") % 4
    one = lambda r, s: F.create_map(F.lit("lexical"), F.struct(F.lit(r).alias("rank"), F.lit(s).alias("score")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<rank:int,score:double>>"))
    hits = F.when(i == 0, one(1, 0.5)).when(i == 1, one(0, 0.5)).when(i == 2, one(1, float("inf"))).otherwise(none)
    return table(spark, sf, "documents").select("doc_id", contracts.valid_provenance(hits).alias("fine"))


@query("SELECT doc_id, lang || ' café ' || lower(source) AS terms FROM documents")
def entity_tokens(spark, sf):
    x = F.concat("lang", F.lit(" &amp; Caf&eacute; <b>"), F.upper("source"), F.lit("</b> https://a.b/c www.d.e"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.Analyzer()(x), " ").alias("terms"))


@query("SELECT doc_id, 'cafe ' || lang AS terms FROM documents")
def analyzer_options(spark, sf):
    """Without accents, numbers and stopwords."""
    a = T.Analyzer(stopwords=T.read_stopwords("The # article\nof"), accents=False, numbers=False)
    x = F.concat(F.lit("The Café "), F.col("doc_id") + 10, F.lit(" of "), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(a(x), " ").alias("terms"))


@query("WITH " + POOL + " SELECT id_query, id, CASE profile WHEN 'lexical' THEN 'bm25' ELSE profile END AS profile, CAST(rank AS INTEGER) AS rank, score FROM top")
def renamed_memberships(spark, sf):
    pool = retrieval.pooled(profile_ranks(spark, sf), 10)
    return retrieval.memberships(pool.withColumn("retrieval", retrieval.renamed_profiles(F.col("retrieval"), {"lexical": "bm25"})))


@query(with_base("SELECT id_query, id_dataset, judge AS model, reason, CASE WHEN relevance IS NULL THEN 'invalid_schema' END AS error FROM v"))
def annotation_stream(spark, sf):
    """Judgments that arrive as a stream, upserted; those that were invalid are replaced by the ones that come later."""
    v = votes_of(spark, sf).select("id_query", "id_dataset", F.col("judge").alias("model"), "reason", F.when(F.col("relevance").isNull(), "invalid_schema").alias("error"))
    path = writers.workspace(spark, "stream")
    bad = v.filter("error is null").withColumn("reason", F.lit("unrelated")).withColumn("error", F.lit("invalid_json"))
    for k, part in enumerate((bad, v)):
        part.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(v.schema).parquet(f"{path}/in")
        resume.annotation_stream(source, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return resume.current(spark, f"{path}/table")


@query(with_base("SELECT count(*) AS pairs, count(DISTINCT id_query) AS queries, count(*) FILTER (default_relevance) AS relevant, count(*) FILTER (NOT default_relevance) AS non_relevant, count(*) FILTER (audited) AS audited FROM ass", TRUTH, ASSEMBLED))
def release_summary_file(spark, sf):
    """The summary as a JSON document with its settings, read back."""
    path = writers.workspace(spark, "summary")
    writers.write_summary(release_summary(spark, sf), path, {"default_judge": "judge_c"})
    return spark.read.json(path).select("summary.pairs", "summary.queries", "summary.relevant", "summary.non_relevant", "summary.audited")


@query(with_base("SELECT id_query, id_dataset, default_relevance FROM ass", TRUTH, ASSEMBLED))
def read_validated_benchmark(spark, sf):
    """The published benchmark: fields, uniqueness and the default judge's labels are checked as it is read."""
    path = writers.workspace(spark, "benchmark")
    writers.write_jsonl(_benchmark(spark, sf), path)
    return readers.validated_benchmark(readers.read_benchmark(spark, path), "judge_c").select("id_query", "id_dataset", "default_relevance")


@query("""SELECT meta_file, file_name FROM (SELECT doc_id, 'm' || (doc_id % 50) AS meta_file, 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.csv' WHEN doc_id % 3 = 1 THEN '.TSV' ELSE '.pdf' END AS file_name FROM documents)
WHERE doc_id % 50 <> 7 AND doc_id % 11 <> 4 AND doc_id % 3 < 2""")
def collection_kept(spark, sf):
    """The resources that stay when a collection is reduced."""
    i = F.col("doc_id")
    ending = F.when(i % 3 == 0, ".csv").when(i % 3 == 1, ".TSV").otherwise(".pdf")
    r = table(spark, sf, "documents").select(F.concat(F.lit("m"), i % 50).alias("meta_file"), F.concat(F.lit("f"), i, ending).alias("file_name"), F.concat(F.lit("p"), i).alias("path"), F.lit("k").alias("res_key"), "doc_id")
    rows = r.select("file_name", F.lit(1).alias("row_no"))
    left, _, _ = collection.reduced_collection(r, rows, r.filter(i % 50 == 7).select("meta_file").distinct(), r.filter(i % 11 == 4).select(F.col("path").alias("name")), 3)
    return left.select("meta_file", "file_name")


@query("WITH " + POOL + " SELECT id_query, 'd' || id AS id_dataset, max(CASE WHEN profile = 'lexical' THEN rank END)::INTEGER AS lexical_rank, max(CASE WHEN profile = 'dense_a' THEN rank END)::INTEGER AS dense_a_rank, string_agg(profile, ',' ORDER BY profile) AS profiles FROM top GROUP BY id_query, id")
def hit_payloads(spark, sf):
    """What of a hit is passed on: an id from its fallbacks, and ranks by profile."""
    pool = retrieval.pooled(profile_ranks(spark, sf), 10)
    hits = pool.select("id_query", F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), F.col("id"))).alias("id"), F.concat(F.lit("d"), F.col("id")).alias("identifier"), "retrieval")
    p = retrieval.payload(hits, ("id",), {"id": ("identifier",)})
    rank = lambda n: F.element_at("retrieval", F.lit(n))["rank"]
    return p.select("id_query", F.col("id").alias("id_dataset"), rank("lexical").alias("lexical_rank"), rank("dense_a").alias("dense_a_rank"), F.array_join(F.array_sort(F.map_keys("retrieval")), ",").alias("profiles"))


@query(with_base("SELECT reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY reason"))
def reason_counts(spark, sf):
    """Reasons that have a meaning; every one is among those of the settings."""
    v = votes_of(spark, sf).filter("reason is not null")
    return contracts.enforced(v, F.col("reason").isin(*REASONS), "unknown reason", "reason").groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH " + RESOURCES + " SELECT meta_file, res_key, CASE WHEN container = 'dict' THEN res_key WHEN k = 0 THEN 'p' || (doc_id * 3) ELSE 'f' || k || '.csv' END AS identifier, CASE k WHEN 0 THEN 'n' WHEN 1 THEN 'f1.csv' ELSE 'f2.csv' END AS name, CASE k WHEN 1 THEN 'd' ELSE 'p' || (doc_id * 3 + k) END AS location FROM res")
def resource_names(spark, sf):
    """What invalid resources are called, and the name and location of each by their fallbacks."""
    r = readers.resources_of(_metadata(spark, sf))
    file = F.when(F.col("ord") > 0, F.col("file_name")).otherwise("")
    path = F.when(F.col("ord") != 1, F.col("path"))
    found = collection.invalid_identifier(F.col("container"), F.col("res_key"), file, F.col("path"))
    return r.select("meta_file", "res_key", found.alias("identifier"), collection.resource_name(file, F.lit("n"), F.lit("t")).alias("name"), collection.resource_path(path, F.lit("d"), F.lit("a")).alias("location"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(10))), '|')) AS lines_md5 FROM documents".replace("\\\\", "\\"))
def unpadded_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(collection.unpadded_lines(F.col("text")), "|")).alias("lines_md5"))


@query(with_base("SELECT id_query || '||' || id_dataset AS pair_key, " + ", ".join(f"max(CASE WHEN judge = '{j}' THEN relevance END) AS {j}_relevance, max(CASE WHEN judge = '{j}' THEN reason END) AS {j}_reason" for j in JUDGES) + " FROM v WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL"))
def sampled_labels_by_judge(spark, sf):
    v = votes_of(spark, sf).withColumn("pair_key", T.pair_key(F.col("id_query"), F.col("id_dataset")))
    sample = pairs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi").select(T.pair_key(F.col("id_query"), F.col("id_dataset")).alias("pair_key"))
    return judge.by_judge(v, sample, JUDGES)


@query(with_base("SELECT id_query, id_dataset, judge, doc_id % 4 <> 1 OR relevance IS NULL AS ok FROM v"))
def stored_annotation_contract(spark, sf):
    """Judgments with an error, or a relevance that follows from their reason; every fourth was turned round."""
    v = votes_of(spark, sf).withColumn("error", F.when(F.col("relevance").isNull(), "invalid_json"))
    v = v.withColumn("relevance", F.when(F.col("doc_id") % 4 == 1, ~F.col("relevance")).otherwise(F.col("relevance")))
    return judge.stored_contract(v).select("id_query", "id_dataset", "judge", "ok")


@query("SELECT doc_id, 'query address city toe ' || lang AS terms FROM documents")
def stemmed_terms(spark, sf):
    """An Analyzer with a morphology."""
    x = F.concat(F.lit("Queries ADDRESS cities toes "), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.Analyzer(entities=False, morphology=T.singulars)(x), " ").alias("terms"))


@query("SELECT conv_id, turn, md5('Does the dataset answer the query?' || chr(10) || chr(10) || 'q1 / t1: yes' || chr(10) || 'Query: ' || role || chr(10) || 'Title: ' || coalesce(text, '') || chr(10) || 'Answer with one JSON object with the keys \"main_resource\", \"scope\", \"supporting_field\", \"quote\" and \"reason\".') AS prompt_md5 FROM conversations")
def prompt_with_examples(spark, sf):
    """Another blueprint, one example, and no limit."""
    p = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("query"), F.col("text").alias("title"))
    shots = [{"query": "q1", "title": "t1", "answer": "yes"}, {"query": "q2", "title": "t2", "answer": "no"}]
    return judge.prompts(p, "short", ("title",), {}, shots, 1).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


@query(with_base("SELECT id_query, id_dataset, model, 1 AS attempts, '{\"reason\": \"' || reason || '\"}' AS raw FROM pairs, (VALUES ('small', 'generic'), ('large', 'subtype')) t(model, reason)"))
def dispatched_judges(spark, sf):
    """Judges by the platform of their registry entry, connected once in each process."""
    connector = lambda reason: lambda model, entry: lambda prompts: [f'{{"reason": "{reason}"}}'] * len(prompts)
    models = {"small": {"platform": "Ollama"}, "large": {"platform": "OpenAI API"}}
    return judge.judged(pairs_of(spark, sf).withColumn("prompt", F.col("id_dataset")), judge.dispatched(models, {"ollama": connector("generic"), "openai": connector("subtype")}))


def _files(spark, sf):
    """Forty metadata files, each with what its documents have in all."""
    d = table(spark, sf, "documents").groupBy((F.col("doc_id") % 40).alias("number")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    path = writers.workspace(spark, "metadata")
    doc = F.concat(F.lit('{"title":"t","n":'), F.col("n"), F.lit(',"c":'), F.col("c"), F.lit("}"))
    writers.write_documents(d.select("number", doc.alias("value")), path, "meta_{}.json")
    return path


FILES = "f AS (SELECT 'meta_' || (doc_id % 40) || '.json' AS meta_file, '{\"title\":\"t\",\"n\":' || count(*) || ',\"c\":' || CAST(sum(n_chars) AS BIGINT) || '}' AS doc FROM documents GROUP BY doc_id % 40)"


@query("WITH " + FILES + " SELECT meta_file, CAST(row_number() OVER (ORDER BY meta_file) - 1 AS BIGINT) AS ord, doc FROM f")
def metadata_files(spark, sf):
    """Metadata records of files, in order of their names."""
    return readers.read_metadata(spark, _files(spark, sf)).select("meta_file", F.col("ord").cast("long").alias("ord"), F.trim(F.regexp_replace("doc", "\n", "")).alias("doc"))


@query("WITH " + FILES + " SELECT meta_file AS file_name, md5(doc || chr(10)) AS md5 FROM f")
def file_hashes(spark, sf):
    """Raw files by the hash of their bytes."""
    return readers.read_files(spark, _files(spark, sf)).select("file_name", "md5")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hola... mundo! ' || doc_id WHEN 1 THEN 'temp 20° c, ok ' || doc_id WHEN 2 THEN '1,5 km (' || doc_id || ')' ELSE 'a #b?! ' || doc_id END AS normalized FROM documents")
def query_rules(spark, sf):
    """Texts that meet the rules of queries, and what those make of them."""
    i, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    raw = F.when(i == 0, F.concat(F.lit("Hola.....  Mundo !!! "), n)).when(i == 1, F.concat(F.lit("Temp  20°C,ok "), n)).when(i == 2, F.concat(F.lit("1,5 KM ( "), n, F.lit(" )"))).otherwise(F.concat(F.lit("a##b ??!! "), n))
    return table(spark, sf, "documents").select("doc_id", T.query_text(raw).alias("normalized"))
