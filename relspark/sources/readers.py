"""Readers of the formats of a benchmark's stages, all through Spark's own readers, so any store that Spark reaches will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ContractError
from ..functions.text import pair_key, parsed_pair, strict_bool
from ..operators.contracts import all_rows, checked_queries, none_of, not_empty, same_keys, unique

FIELDS = ("id", "title", "description", "header", "content", "metadato_fileName", "resource_fileName")
HIT = "struct<" + ", ".join(f"{f}:string" for f in FIELDS) + ", retrieval:map<string,struct<rank:int,score:double>>{}>"
ANNOTATION = "struct<main_resource:string,scope:string,supporting_field:string,quote:string,reason:string,relevance:boolean,error:string,detail:string,raw_output:string>"
POOL = "id_query int, query string, hits array<" + HIT.format("") + ">, _corrupt string"
ANNOTATED = "id_query int, query string, hits array<" + HIT.format(f", annotations:map<string,{ANNOTATION}>") + ">, _corrupt string"


#: Bytes of a table for each core, under which its rows are dealt out again.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where it is small: one file of one row group would be read, and worked on, by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id_query, query) of a comma- or tab-separated file; the header tells which."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ContractError(f"{path} is empty")
    line = head[0][0]
    return checked_queries(spark.read.csv(path, header=True, sep="\t" if line.count("\t") > line.count(",") else ",", multiLine=True))


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    rows = all_rows(rows.withColumn("number", F.try_to_number(F.regexp_extract("file", r"^query_([0-9]+)\.json$", 1), F.lit("999999999")).cast("int")), F.col("number").isNotNull() & F.col("_corrupt").isNull(), "files that are no query documents")
    unique(not_empty(rows.select("number"), f"no query documents in {path}"), "number")
    return rows


def _pairs(rows: DataFrame, extra: list[str]) -> DataFrame:
    out = rows.select("id_query", "query", F.posexplode("hits").alias("result_index", "hit")).select("id_query", "query", "result_index", *[F.col(f"hit.{f}").alias(f) for f in FIELDS], "hit.retrieval", *[f"hit.{x}" for x in extra])
    out = out.withColumn("id_dataset", F.trim("id")).withColumn("pair_key", pair_key(F.col("id_query"), F.col("id")))
    return all_rows(out, (F.col("id_dataset") != "") & ~F.col("id_dataset").contains("||"), "unsafe dataset ids")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs of query_<n>.json files, in pooled order as result_index."""
    return _pairs(_documents(spark, path, POOL), [])


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """As read_pool, with annotations by model."""
    return _pairs(_documents(spark, path, ANNOTATED), ["annotations"])


def long_annotations(pairs: DataFrame) -> DataFrame:
    """(pair_key, id_query, id_dataset, judge, annotation fields), a row for each model."""
    return pairs.select("pair_key", "id_query", "id_dataset", F.explode("annotations").alias("judge", "a")).select("pair_key", "id_query", "id_dataset", "judge", "a.*")


def read_pair_filter(spark: SparkSession, path: str) -> DataFrame:
    """(id_query, id_dataset) of a CSV or JSON-lines file with pair_key, the two ids, or both in agreement."""
    json_lines = path.lower().endswith((".jsonl", ".ndjson"))
    rows = spark.read.json(path, primitivesAsString=True) if json_lines else spark.read.csv(path, header=True, multiLine=True)
    have = set(rows.columns)
    if not ({"pair_key"} <= have or {"id_query", "id_dataset"} <= have):
        raise ContractError("a pair filter needs pair_key, or id_query and id_dataset")
    text = lambda c: F.trim(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    key = parsed_pair(F.col("pair_key")) if "pair_key" in have else F.lit(None).cast("struct<id_query:string,id_dataset:string>")
    rows = rows.select(key.alias("k"), text("id_query").alias("q"), text("id_dataset").alias("d"))
    none_of(rows.filter("(k is not null and (k.id_query != q or k.id_dataset != d)) or (k is null and (q is null or d is null))"), "rows without one clear pair")
    out = rows.select(F.coalesce("k.id_query", "q").alias("id_query"), F.coalesce("k.id_dataset", "d").alias("id_dataset"))
    return unique(not_empty(out, "the pair filter is empty"), "id_query", "id_dataset")


def read_humans(spark: SparkSession, paths: dict[str, str], sample: DataFrame | None = None) -> DataFrame:
    """Annotations of each named annotator's CSV, with annotator; empty cells are null and relevance is a strict boolean.

    With a sample (pair_key), each annotator has exactly its pairs.
    """
    out = None
    for name, path in paths.items():
        part = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("annotator", F.lit(name))
        missing = {"pair_key", "id_query", "id_dataset", "reason", "relevance"} - set(part.columns)
        if missing:
            raise ContractError(f"{path} lacks {sorted(missing)}")
        part = part.withColumn("label", strict_bool(F.col("relevance")))
        part = unique(all_rows(part, F.col("label").isNotNull(), "relevance must be true or false"), "pair_key").withColumn("relevance", F.col("label")).drop("label")
        part = _covering(part, sample)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A frozen sample with its order, CSV or JSON lines."""
    rows = spark.read.json(path) if path.lower().endswith((".jsonl", ".ndjson")) else spark.read.csv(path, header=True, multiLine=True)
    if "order" in rows.columns:
        rows = rows.withColumn("order", F.col("order").cast("int"))
    else:
        from pyspark.sql import Window

        rows = rows.withColumn("order", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # a sample is small
    return unique(rows, "order")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A published JSON-lines benchmark."""
    return not_empty(spark.read.json(path), "the benchmark is empty")


def _covering(rows: DataFrame, sample: DataFrame | None) -> DataFrame:
    if sample is not None:
        same_keys(sample, rows, ["pair_key"])
    return rows


def read_aggregation(spark: SparkSession, path: str, sample: DataFrame | None = None) -> DataFrame:
    """Panels of a CSV: 0 to 3 valid votes, a label if and only if there are three, a pair once a panel; with a sample
    (pair_key), exactly its pairs."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {"pair_key", "combination", "valid_votes", "aggregated_relevance"} - set(rows.columns)
    if missing:
        raise ContractError(f"{path} lacks {sorted(missing)}")
    label = strict_bool(F.col("aggregated_relevance"))
    rows = rows.withColumn("valid_votes", F.expr("try_cast(valid_votes as int)")).withColumn("_known", F.col("aggregated_relevance").isNull() | label.isNotNull()).withColumn("aggregated_relevance", label)
    all_rows(rows, F.col("valid_votes").between(0, 3) & F.col("_known") & ((F.col("valid_votes") == 3) == F.col("aggregated_relevance").isNotNull()), "panels that break the contract")
    return _covering(unique(rows.drop("_known"), "pair_key", "combination"), sample)


def read_majority(spark: SparkSession, path: str, sample: DataFrame | None = None) -> DataFrame:
    """Human majorities of a CSV: strict booleans, a pair once; with a sample (pair_key), exactly its pairs."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {"pair_key", "majority_relevance"} - set(rows.columns)
    if missing:
        raise ContractError(f"{path} lacks {sorted(missing)}")
    rows = rows.withColumn("majority_relevance", strict_bool(F.col("majority_relevance")))
    return _covering(unique(all_rows(rows, F.col("majority_relevance").isNotNull(), "majorities must be true or false"), "pair_key"), sample)


def validated_benchmark(df: DataFrame, default_judge: str, judges: Sequence[str] | None = None) -> DataFrame:
    """A benchmark with its fields, a pair once, labels of the named default judge, its judges, and a relevant pair for
    every query; raises otherwise."""
    needed = {"id_query", "id_dataset", "default_relevance", "default_relevance_source", "annotations"}
    if missing := needed - set(df.columns):
        raise ContractError(f"the benchmark lacks {sorted(missing)}")
    all_rows(df.select("id_query", "id_dataset", "default_relevance", "default_relevance_source"), F.col("id_query").isNotNull() & (F.trim("id_dataset") != "") & F.col("default_relevance").isNotNull() & (F.col("default_relevance_source") == default_judge), "pairs that break the contract")
    unique(df, "id_query", "id_dataset")
    if judges is not None:
        fields = set(df.schema["annotations"].dataType.names) if hasattr(df.schema["annotations"].dataType, "names") else None
        if fields is not None and fields != set(judges):
            raise ContractError(f"annotations are of {sorted(fields)}")
    none_of(df.groupBy("id_query").agg(F.count_if("default_relevance").alias("relevant")).filter("relevant = 0"), "queries without a relevant pair")
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(meta_file, ord, doc): raw JSON texts of meta_* files in order of name. Keys keep their order in the text."""
    from pyspark.sql import Window

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("meta_file"), F.col("value").alias("doc"))
    rows = rows.filter(F.lower("meta_file").startswith("meta_"))
    bucket = F.substring("meta_file", 1, 64)
    sizes = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n")).select("b", "before")
    own = F.row_number().over(Window.partitionBy("b").orderBy("meta_file"))
    return rows.withColumn("b", bucket).withColumn("own", own).join(before, "b").select("meta_file", (F.col("before") + F.col("own") - 1).alias("ord"), "doc")


def resources_of(metadata: DataFrame) -> DataFrame:
    """(meta_file, container, res_key, ord, raw, path, file_name, encoding, delimiter, field_names) of lists and objects of resources; entries that are no objects are skipped."""
    raw = F.get_json_object("doc", "$.resources")
    is_list = F.trim(raw).startswith("[")
    listed = F.transform(F.from_json(F.when(is_list, raw), "array<string>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    mapped = F.map_entries(F.from_json(F.when(~is_list, raw), "map<string,string>"))
    rows = metadata.select("meta_file", F.when(is_list, "list").otherwise("dict").alias("container"), F.posexplode(F.coalesce(listed, mapped)).alias("ord", "r"))
    rows = rows.select("meta_file", "container", F.col("r.key").alias("res_key"), "ord", F.col("r.value").alias("raw")).filter(F.trim("raw").startswith("{"))
    text = lambda p: F.get_json_object("raw", p)
    names = F.transform(F.from_json(text("$.schema.fields"), "array<struct<name:string>>"), lambda x: x["name"])
    return rows.select("*", text("$.path").alias("path"), text("$.fileName").alias("file_name"), text("$.encoding").alias("encoding"), text("$.delimiter").alias("delimiter"), names.alias("field_names"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content, md5) of raw files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.md5("content").alias("md5"))
