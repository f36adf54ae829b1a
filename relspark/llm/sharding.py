"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files). Compaction merges runs of similar size, tier by tier,
until no tier has `fanout` of them; a shard that has reached half the target size is sealed. Merges are planned on the
manifest's sizes and each surviving row is rewritten once, into the last shard that it would reach.

Every step ends by committing a version. Its manifest, a Parquet table of one line a shard, is written whole under a
name of its own; then the version's file is created exclusively and names it. A version counts once that name ends in
a line break, so readers see the old version or the new one. A writer that dies before leaves files that nothing names;
one that dies within the creation leaves a void version, which later writers pass over after `stale` seconds. Shards
of old versions stay readable until vacuum(), which also deletes what dead writers left.

Scale: rows, manifest lines and plans stay in Spark tables; the driver holds a folder name for each append or merge
whose shards are all alive, file names only for the remainders of a merged folder, and plans at most PLANNED lines in
a task. A merge is one shuffle to the merged shards by their number, each of which is bounded by the target size, so a
hot source or key makes no large task.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, new_path, small_or_shuffled, stored

#: Rows of an arrival shard, bytes of text that a shard is merged up to, bytes of the lowest tier, runs that are merged at once.
ARRIVAL_ROWS, TARGET_BYTES, LEAST_BYTES, FANOUT = 2_048, 64 << 20, 1 << 20, 4
#: Shards whose merges are planned together, and seconds after which a writer counts as dead.
PLANNED, STALE = 65_536, 3_600
LINES = "shard string, folder string, files long, rows long, bytes long, born long"


def tier(size: int, least: int = LEAST_BYTES, fanout: int = FANOUT) -> int:
    return int(math.log(size / least, fanout)) + 1 if size >= least else 0


def planned(sizes: dict[str, int], target: int = TARGET_BYTES, least: int = LEAST_BYTES, fanout: int = FANOUT) -> list[list[str]]:
    """Lists of at least two shard names to merge, from sizes by name in order of age.

    The lowest tier with fanout runs merges its oldest, as many as fit the target; a run of half the target is sealed.
    """
    tiers: dict[int, list[tuple[list[str], int]]] = defaultdict(list)
    sealed = []

    def put(run: tuple[list[str], int]) -> None:
        (sealed if 2 * run[1] >= target else tiers[tier(run[1], least, fanout)]).append(run)

    for name, size in sizes.items():
        put(([name], size))
    while full := [k for k, runs in tiers.items() if len(runs) >= fanout]:
        own, names, total = tiers[min(full)], [], 0
        while own and (len(names) < 2 or total + own[0][1] <= target) and total + own[0][1] <= target * 2:
            run = own.pop(0)
            names, total = names + run[0], total + run[1]
            if 2 * total >= target:
                break
        put((names, total))
    return [names for names, _ in [*sealed, *(r for runs in tiers.values() for r in runs)] if len(names) > 1]


def plan(lines: DataFrame, target: int, least: int, fanout: int) -> DataFrame:
    """(shard, to) of the shards that are merged, to numbered from 0; planned in blocks of about PLANNED unsealed shards."""
    small = lines.filter(2 * F.col("bytes") < target)
    blocks = max(1, -(-small.count() // PLANNED))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["born", "shard"])
        merges = planned(dict(zip(rows["shard"], rows["bytes"].astype(int), strict=True)), target, least, fanout)
        return pd.DataFrame([(n, rows["block"].iloc[0], k) for k, names in enumerate(merges) for n in names], columns=["shard", "block", "k"])

    own = small.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(run, "shard string, block int, k int")
    own = stored(own, "plan")
    before, start = 0, {}
    for r in own.groupBy("block").agg(F.max("k").alias("k")).orderBy("block").collect():  # a row for each block
        start[r.block], before = before, before + r.k + 1
    at = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("block")] if start else F.lit(0)
    return own.select("shard", (at + F.col("k")).cast("int").alias("to"))


class Shards:
    """A set of shards under a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, stale: int = STALE):
        self.spark, self.root, self.stale = spark, root.rstrip("/"), stale
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for x in ("versions", "manifests", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{x}"))

    def _listed(self, folder: str) -> Iterator[tuple[str, float]]:
        """(name, age in seconds) of what a folder holds."""
        for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
            if not f.getPath().getName().startswith("."):
                yield f.getPath().getName(), time.time() - f.getModificationTime() / 1000

    def _named(self, version: int) -> str | None:
        """The manifest that a version names; None for a void one."""
        stream = self._fs.open(self._path(f"{self.root}/versions/v{version:08d}"))
        try:
            text = bytes(stream.readNBytes(1000)).decode()
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def versions(self) -> list[int]:
        return sorted(v for n, _ in self._listed("versions") if self._named(v := int(n[1:])) is not None)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The lines of a version (default: the newest), one for each shard; none of version 0."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], LINES)
        return self.spark.read.schema(LINES).parquet(f"{self.root}/manifests/{self._named(version)}")

    def _commit(self, base: int, lines: DataFrame) -> int:
        """Publishes lines as the version after base and returns its number; raises where another writer came first."""
        name = uuid.uuid4().hex
        lines.select(*[c.split()[0] for c in LINES.split(", ")]).coalesce(8).write.parquet(f"{self.root}/manifests/{name}")
        taken = {int(n[1:]): age for n, age in self._listed("versions")}
        new = base + 1
        while new in taken and taken[new] > self.stale and self._named(new) is None:  # its writer died
            new += 1
        try:
            out = self._fs.create(self._path(f"{self.root}/versions/v{new:08d}"), False)
        except Exception as e:
            raise RuntimeError(f"version {new} was taken by another writer") from e
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
        if max(self.versions()) > new:
            raise RuntimeError(f"version {new} was passed over as stale")
        return new

    def _written(self, df: DataFrame, data: str, born: int) -> DataFrame:
        """The manifest lines of what df's tasks write to data: a shard is a file, named data/file."""
        df.write.option("maxRecordsPerFile", ARRIVAL_ROWS if "arrivals" in data else 0).option("compression", "zstd").parquet(f"{self.root}/{data}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{data}")
        size = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in df.columns else F.lit(0)
        found = back.groupBy(back.metadataColumn("_metadata")["file_name"].alias("f")).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))
        lines = stored(found.select(F.concat(F.lit(f"{data}/"), "f").alias("shard"), F.lit(data).alias("folder"), "rows", "bytes", F.lit(born).cast("long").alias("born")), "lines")
        return lines.withColumn("files", F.lit(lines.count()).cast("long"))

    def append(self, df: DataFrame) -> int:
        """df as arrival shards of at most ARRIVAL_ROWS rows each, without a shuffle; the new version."""
        base = max(self.versions(), default=0)
        new = self._written(df, f"data/arrivals-{base + 1:08d}-{uuid.uuid4().hex[:8]}", base + 1)
        return self._commit(base, self.manifest(base).unionByName(new))

    def _rows(self, lines: DataFrame) -> tuple[DataFrame | None, str]:
        """The rows of some lines with their shard in a further column, whose name is returned."""
        parts = lines.groupBy("folder").agg(F.count("*").alias("n"), F.first("files").alias("files")).collect()  # a row for each append or merge
        paths = [f"{self.root}/{r.folder}" for r in parts if r.n == r.files]
        if some := [r.folder for r in parts if r.n < r.files]:
            paths += [f"{self.root}/{r.shard}" for r in lines.filter(F.col("folder").isin(some)).select("shard").toLocalIterator()]
        if not paths:
            return None, ""
        shard = f"_shard_{uuid.uuid4().hex[:8]}"
        schema = self.spark.read.parquet(paths[0]).schema
        df = self.spark.read.schema(schema).parquet(*paths)
        at = df.metadataColumn("_metadata")
        return df.withColumn(shard, F.concat(F.lit("data/"), F.element_at(F.split(at["file_path"], "/data/"), -1))), shard

    def compact(self, target: int = TARGET_BYTES, least: int = LEAST_BYTES, fanout: int = FANOUT) -> int:
        """Merges until no tier is full; the newest version. A failure before the commit leaves the old one as it was."""
        base = max(self.versions(), default=0)
        lines = self.manifest(base)
        to = plan(lines, target, least, fanout)
        count = to.agg(F.coalesce(F.max("to") + 1, F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
        if not count.n:
            return base
        rows, shard = self._rows(lines.join(small_or_shuffled(to, count.rows), "shard", "left_semi"))
        names, number = [c for c in rows.columns if c != shard], f"_to_{uuid.uuid4().hex[:8]}"
        dealt = rows.join(small_or_shuffled(to.select(F.col("shard").alias(shard), F.col("to").alias(number)), count.rows), shard)
        dealt = dealt.repartitionById(int(count.n), F.col(number)).select(*names)
        new = self._written(dealt, f"data/merged-{base + 1:08d}-{uuid.uuid4().hex[:8]}", base + 1)
        kept = lines.join(small_or_shuffled(to.select("shard"), count.rows), "shard", "left_anti")
        return self._commit(base, kept.unionByName(new))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with their shard in _shard; None for a version without shards."""
        rows, shard = self._rows(self.manifest(version))
        return None if rows is None else rows.select(F.col(shard).alias("_shard"), *[F.col(f"`{c}`") for c in rows.columns if c not in (shard, "_shard")])

    def vacuum(self, older: int = 0) -> None:
        """Deletes shards, manifests and void versions that the newest version doesn't need and that are `older` seconds old."""
        newest = max(self.versions(), default=0)
        lines = self.manifest(newest)
        alive = {r.folder for r in lines.select("folder").distinct().collect()}  # a row for each append or merge
        gone = [f"data/{n}" for n, age in self._listed("data") if f"data/{n}" not in alive and age >= older]
        named = {self._named(v) for v in self.versions()}
        gone += [f"manifests/{n}" for n, age in self._listed("manifests") if n not in named and age >= older]
        old = None
        for v in self.versions():
            if v != newest:
                old = self.manifest(v) if old is None else old.unionByName(self.manifest(v))
        if old is not None:
            dead = old.filter(F.col("folder").isin(*alive)).select("shard").distinct().join(lines, "shard", "left_anti")
            gone += [r.shard for r in dead.toLocalIterator()]
        delete(self.spark, *[f"{self.root}/{x}" for x in gone])


def stored_names(names: list[str]) -> list[str]:
    """Names for storage: those that a file can't tell apart from an earlier one, but for case, get a number."""
    seen, out = set(), []
    for n in names:
        new, k = n, 2
        while new.lower() in seen:
            new, k = f"{n}_{k}", k + 1
        seen.add(new.lower())
        out.append(new)
    return out


def sharded(docs: DataFrame, root: str | None = None, target: int = TARGET_BYTES, arrivals: int = 1) -> DataFrame:
    """docs (doc_id, text and others) appended in `arrivals` parts and compacted: doc_id, shard, shard_rows, shard_bytes, version.

    Nulls in any column are stored as they are and count as no bytes; repeated rows stay; a table without rows gives
    none. All columns are stored, also those named like this module's own; names that differ only in case get a number.
    """
    spark = docs.sparkSession
    shards, docs = Shards(spark, root or new_path(spark, "shards")), docs.toDF(*stored_names(docs.columns))
    for k in range(arrivals):
        shards.append(docs if arrivals == 1 else docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
    version = shards.compact(target)
    rows, lines = shards.read(version), shards.manifest(version)
    if rows is None:
        return spark.createDataFrame([], "doc_id long, shard string, shard_rows long, shard_bytes long, version long")
    sizes = lines.select(F.col("shard").alias("_shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    out = rows.select("doc_id", "_shard").join(small_or_shuffled(sizes), "_shard")
    return out.select("doc_id", F.regexp_replace("_shard", "^data/", "").alias("shard"), "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
