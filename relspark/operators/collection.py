"""Preparation of a crawled collection: duplicates, validity, sampling of rows, dataset records."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import CELL_CHARS, CONTENT_CHARS, CONTENT_ROWS, MODEL_CHARS, composed_content, model_text, header_line, squeezed
from .contracts import all_rows


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df with kept: whether a row is the first of its key. Null keys are alike."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def functional_key(title: Column, description: Column, temporal: Column, geo: Column, hashes: Column) -> Column:
    """What makes metadata records the same: texts, coverage and the sorted multiset of file hashes."""
    return F.struct(title.alias("title"), description.alias("description"), temporal.alias("temporal"), F.lower(F.trim(F.coalesce(geo, F.lit("")))).alias("geo"), F.sort_array(hashes).alias("hashes"))


def duplicate_groups(df: DataFrame, key: Sequence[str], name: str, order: str) -> DataFrame:
    """Per key with several rows: how many, the first name, and the others in order."""
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, name))).alias("rows")).filter("n > 1")
    return out.select(*key, "n", F.col("rows")[0][name].alias("kept"), F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r[name]).alias("duplicates"))


def preferred(df: DataFrame, key: Sequence[str], encoding: str = "encoding", delimiter: str = "delimiter", path: str = "path", order: str = "ord") -> DataFrame:
    """Among equal resources: UTF-8 first, then a semicolon as delimiter, the smaller path, the earlier one."""
    utf8 = F.upper(F.coalesce(encoding, F.lit(""))).contains("UTF-8")
    return first_of(df, key, [utf8.desc(), (F.trim(F.coalesce(delimiter, F.lit(""))) == ";").desc(), F.coalesce(path, F.lit("")), order])


def invalid_resource(path: Column, file_name: Column, lines: Column, fields: Column, min_rows: int) -> Column:
    """Without a path or file name, with too few non-blank lines, or without a schema."""
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    return empty(path) | empty(file_name) | (F.coalesce(lines, F.lit(0)) < 1 + min_rows) | (F.coalesce(F.size(fields), F.lit(0)) <= 0)


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\r\n|\r|\n", -1), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]")))


def tabular(file_name: Column, path: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(file_name, F.lit("")), path, F.lit(""))).rlike(r"\.(csv|tsv)$")


def file_name_of(file_name: Column, path: Column) -> Column:
    """The file name, or else the last part of the path."""
    return F.coalesce(F.nullif(file_name, F.lit("")), F.regexp_extract(F.coalesce(path, F.lit("")), "([^/]+)/*$", 1), F.lit(""))


def invalid_identifier(container: Column, key: Column, file_name: Column, path: Column) -> Column:
    """What an invalid resource is called: its key in an object of resources, else its file name or path."""
    return F.when(container == "dict", key).otherwise(F.coalesce(F.nullif(file_name, F.lit("")), path))


def resource_name(file_name: Column, name: Column, title: Column) -> Column:
    """File name, name or title, the first that isn't empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (file_name, name, title)], F.lit("Recurso"))  # the last is a fixed value


def resource_path(path: Column, download: Column, access: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (path, download, access)])


def unpadded_lines(content: Column) -> Column:
    """Lines without white space, separators and quotes that pad their ends."""
    return F.transform(F.split(content, r"\r\n|\r|\n", -1), lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))


def delimiter_of(declared: Column, name: Column, default: str = ";", tsv_first: bool = False) -> Column:
    """The declared delimiter, a tab for .tsv, or the default; tsv_first puts the ending before the declaration."""
    said = F.when(declared == "\t", declared).otherwise(F.nullif(F.trim(F.coalesce(declared, F.lit(""))), F.lit("")))
    tsv = F.when(F.lower(F.coalesce(name, F.lit(""))).endswith(".tsv"), "\t")
    return F.coalesce(tsv, said, F.lit(default)) if tsv_first else F.coalesce(said, tsv, F.lit(default))


def _rows(content: bytes, encoding: str | None, delimiter: str, escape: str | None = None) -> list[list[str]]:
    return list(csv.reader(io.StringIO(content.decode(encoding or "utf-8", "ignore"), newline=""), delimiter=delimiter, escapechar=escape))


@F.pandas_udf(StringType())
def table_md5(content: pd.Series, encoding: pd.Series, delimiter: pd.Series) -> pd.Series:
    """MD5 of a table's cells with white space squeezed, cells and rows ended by separators; null where it can't be read."""

    def one(c: bytes | None, e: str | None, d: str | None) -> str | None:
        try:
            digest = hashlib.md5()
            for row in _rows(c, e, d):
                digest.update("".join(" ".join(x.split()) + "\x1f" for x in row).encode() + b"\x1e")
            return digest.hexdigest()
        except Exception:  # noqa: BLE001  an unreadable table is no duplicate of anything
            return None

    return pd.Series([one(*x) for x in zip(content, encoding, delimiter, strict=True)], dtype=object)


@F.pandas_udf(StructType().add("rows", StringType()).add("columns", StringType()))
def table_texts(content: pd.Series, encoding: pd.Series, delimiter: pd.Series, has_fields: pd.Series) -> pd.DataFrame:
    """The first rows of a table as text, by row (without the header line, if there is a schema) and by column (with it)."""

    def one(c: bytes | None, e: str | None, d: str, skip: bool) -> tuple[str, str]:
        try:
            every = _rows(c, e, d, "\\")
        except Exception:  # noqa: BLE001  an unreadable table has no text
            return "", ""
        rows = "".join(d.join(x[:CELL_CHARS] for x in r) + "\n" for r in every[bool(skip) :][:CONTENT_ROWS] if r)
        top = every[:CONTENT_ROWS]
        wide = max(map(len, top), default=0)
        columns = (" ".join((r[i] if i < len(r) else "")[:CELL_CHARS] for r in top)[:MODEL_CHARS] for i in range(wide))
        text = "".join(t + "\n" for t in (" ".join(x.split()).lower() for x in columns) if t)
        return rows[:CONTENT_CHARS], text[:CONTENT_CHARS]

    return pd.DataFrame([one(*x) for x in zip(content, encoding, delimiter, has_fields, strict=True)], columns=["rows", "columns"])


def sampled_rows(df: DataFrame, group: str, row: str, k: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """At most k rows of each group, chosen by a seeded hash (or `order`), so that any partitioning gives the same ones."""
    by = F.xxhash64(F.lit(seed), F.col(group), F.col(row)) if order is None else order
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(by, row))).filter(F.col("_n") <= k).drop("_n")


def without(resources: DataFrame, excluded: DataFrame, names: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Resources none of whose names is in excluded (scope..., name): a disjunctive anti-join as an exploded equi-join."""
    keyed = resources.withColumn("_row", F.xxhash64(F.struct(*resources.columns)))
    hit = keyed.select("_row", *scope, F.explode(F.array(*names)).alias("name")).join(excluded, [*scope, "name"], "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_anti").drop("_row")


def dataset_records(df: DataFrame) -> DataFrame:
    """Records of id, title, description, header, content and normalised texts; those without a title or description are dropped.

    df has identifier, meta_file, title, description, field_names, delimiter, rows_text, columns_text.
    """
    out = df.select(
        F.coalesce(F.nullif(F.col("identifier"), F.lit("")), F.col("meta_file")).alias("id"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce(header_line(F.col("field_names"), F.col("delimiter")), F.lit("")).alias("header"),
        composed_content(F.col("rows_text"), F.col("columns_text")).alias("content"),
        model_text(F.col("title")).alias("dense_title_text"),
        model_text(F.col("description")).alias("dense_description_text"),
    )
    return out.filter("title != '' and description != ''")


def record_checks(records: DataFrame) -> DataFrame:
    """One row of counts: records and those that lack a text or a part."""
    lacks = [F.count_if(squeezed(F.col(c)) == "").alias(f"no_{c}") for c in ("title", "description", "header", "content")]
    return records.agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"), *lacks)


def rebuilt_resources(resources: DataFrame) -> DataFrame:
    """(meta_file, resources): JSON of each metadata record's resources (container, res_key, ord, raw) in their order, as the list or object it was."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "res_key", "raw")))
    rows = resources.groupBy("meta_file").agg(F.max("container").alias("container"), parts.alias("parts"))
    listed = F.array_join(F.transform("parts", lambda r: r["raw"]), ",")
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    mapped = F.array_join(F.transform("parts", lambda r: F.concat(quoted(r["res_key"]), F.lit(":"), r["raw"])), ",")
    return rows.select("meta_file", F.when(F.col("container") == "list", F.concat(F.lit("["), listed, F.lit("]"))).otherwise(F.concat(F.lit("{"), mapped, F.lit("}"))).alias("resources"))


def reduced_collection(resources: DataFrame, rows: DataFrame, excluded_metadata: DataFrame, excluded_resources: DataFrame, k: int = 20, seed: int = 0, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resources that stay, their sampled rows, counters).

    resources has meta_file, res_key, file_name, path; rows has file_name, row_no, cells. Metadata in excluded_metadata
    (meta_file) go with all their resources, then resources with any name in excluded_resources (scope..., name), then
    what is no table; a metadata record with none left is gone. Counters give rows before and after for each file.
    """
    left = resources.join(excluded_metadata.select("meta_file"), "meta_file", "left_anti")
    left = without(left, excluded_resources, ["file_name", "path", "res_key"], scope)
    left = left.filter(tabular(F.col("file_name"), F.col("path")))
    own = rows.join(left.select("file_name").distinct(), "file_name", "left_semi")
    kept = sampled_rows(own, "file_name", "row_no", k, seed)
    counts = own.groupBy("file_name").agg(F.count("*").alias("source_rows")).withColumn("sampled_rows", F.least("source_rows", F.lit(k)))
    return left, kept, counts


def prepared_contract(records: DataFrame, resources: DataFrame, per_record: int = 1) -> None:
    """Raises unless every record has a title, a description and exactly per_record resources."""
    all_rows(records.select("meta_file", "title", "description"), (squeezed(F.col("title")) != "") & (squeezed(F.col("description")) != ""), "records without a title or description")
    n = records.select("meta_file").join(resources.groupBy("meta_file").agg(F.count("*").alias("n")), "meta_file", "left")
    all_rows(n, F.col("n") == per_record, f"records without exactly {per_record} resources")


def first_with_path(resources: DataFrame) -> DataFrame:
    """Per meta_file the first resource in order that has a path."""
    names = [c for c in resources.columns if c != "meta_file"]
    return resources.filter(F.coalesce("path", F.lit("")) != "").groupBy("meta_file").agg(F.min_by(F.struct(*names), "ord").alias("r")).select("meta_file", "r.*")
