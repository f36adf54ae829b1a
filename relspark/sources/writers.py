"""Writers: staged, then published by a rename; through Hadoop's file systems, so any store that Spark reaches will do."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ContractError, resumable
from ..operators.contracts import same_keys


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def published(df: DataFrame, path: str, form: str, overwrite: bool = False, **options: str) -> None:
    """df written to a staging folder beside path and renamed to it, so that readers see all of it or nothing."""
    fs, p = _fs(df, path)
    if fs.exists(p(path)) and not overwrite:
        raise ContractError(f"{path} exists")
    stage = f"{path.rstrip('/')}._stage-{uuid.uuid4().hex[:8]}"
    df.write.format(form).options(**options).save(stage)
    if overwrite:
        fs.delete(p(path), True)
    if not fs.rename(p(stage), p(path)):
        raise ContractError(f"{stage} can't be renamed to {path}")


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as True and False; nulls stay empty cells."""
    return df.select(*[F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, overwrite: bool = False, sep: str = ",", quote_all: bool = False, single: bool = False) -> None:
    out = csv_ready(df)
    published(out.coalesce(1) if single else out, path, "csv", overwrite, header="true", sep=sep, quoteAll=str(quote_all).lower(), nullValue="", emptyValue="", escape='"')


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with explicit nulls."""
    published(df, path, "json", overwrite, ignoreNullFields="false")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a folder of the warehouse, which a cluster shares, or with
    a local master (tests) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        at = getattr(spark, "_own_shared_dir", None) or ("file://" + tempfile.mkdtemp(prefix="relspark-", dir="/tmp") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_relspark")
        spark._own_shared_dir = at
    return at.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files in the folder that executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_query_documents(df: DataFrame, path: str, overwrite: bool = False, expected: DataFrame | None = None) -> None:
    """A JSON document for each row, query_<id_query>.json; with expected (id_query), for exactly its queries."""
    if expected is not None:
        same_keys(expected, df, ["id_query"])
    write_documents(df.select("id_query", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")), path, "query_{}.json", overwrite)


def write_documents(df: DataFrame, path: str, name: str, overwrite: bool = False) -> None:
    """A file for each row of df (a number, a text), named by the number; files are renamed, their content stays on executors."""
    fs, p = _fs(df, path)
    if fs.exists(p(path)) and not overwrite:
        raise ContractError(f"{path} exists")
    stage = f"{path.rstrip('/')}._stage-{uuid.uuid4().hex[:8]}"
    df.toDF("number", "value").repartition("number").write.partitionBy("number").text(stage)
    if overwrite:
        fs.delete(p(path), True)
    fs.mkdirs(p(path))
    for folder in fs.listStatus(p(stage)):
        number = folder.getPath().getName().rpartition("=")[2]
        for f in fs.listStatus(folder.getPath()) if folder.isDirectory() else ():
            if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), p(f"{path}/{name.format(number)}")):
                raise ContractError(f"document {number} can't be published")
    fs.delete(p(stage), True)


def write_summary(df: DataFrame, path: str, settings: dict | None = None, overwrite: bool = False) -> None:
    """The one row of df as a JSON document {summary, settings}."""
    given = F.lit(json.dumps(settings or {}, sort_keys=True))
    published(df.coalesce(1).select(F.struct(*df.columns).alias("summary"), given.alias("settings")), path, "json", overwrite, ignoreNullFields="false")


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """value as a JSON document; raises where there is one already."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        raise ContractError(f"{path} exists")
    stage = p(f"{path}._stage-{uuid.uuid4().hex[:8]}")
    out = fs.create(stage, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if not fs.rename(stage, p(path)):
        raise ContractError(f"{path} can't be published")


def load_json(spark: SparkSession, path: str) -> dict | None:
    """The JSON document at path; None where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p(path)):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def guarded_run(spark: SparkSession, path: str, now: dict, has_results: bool) -> None:
    """Keeps the provenance of a run at path. Where there is some already, or results without any, it must be that of
    the run that goes on."""
    stored = load_json(spark, path)
    if stored is not None or has_results:
        resumable(stored, now)
    else:
        save_json(spark, path, now)


def copied(spark: SparkSession, source: str, target: str) -> bool:
    """source copied to target through Hadoop's file systems, if it is there; whether it was."""
    p, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = p(source), p(target)
    if not a.getFileSystem(conf).exists(a):
        return False
    return bool(spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf))


def in_query_order(df: DataFrame, *more: str) -> DataFrame:
    """Rows by query number, then dataset id, then more: the order in which tables are published."""
    return df.orderBy(F.expr("try_cast(id_query as bigint)"), *[c for c in ("id_dataset",) if c in df.columns], *more)


def write_tables(df: DataFrame, path: str, overwrite: bool = False) -> None:
    published(df, path, "parquet", overwrite)
