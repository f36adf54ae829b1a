"""Queries over the ten operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import classifier, lm
from .decontaminate import contaminated
from .minhash import near_duplicates
from .packing import packed
from .repeats import without_repeats
from .secrets import CLASSES, count_of, joined, scanned
from .sharding import sharded
from .syncmers import fingerprinted, likeness, written
from .url_filters import filtered, host_of


def tokenizer_path() -> str:
    """The public vocabulary that the packing query names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with four-word sets of 0.8 or more alike, over the whole table."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT row, array_to_string(w[k:k + 3], ' ') AS s FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT row, count(*) AS n FROM sh GROUP BY row),
links AS (
  SELECT x.a, x.b FROM (SELECT a.row AS a, b.row AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.row <> b.row GROUP BY ALL) x
  JOIN n na ON na.row = x.a JOIN n nb ON nb.row = x.b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach(a, b) AS (SELECT row, row FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT reach.a AS row, min(d.doc_id) AS component_id FROM reach JOIN d ON d.row = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN comp USING (row) LEFT JOIN n USING (row)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and entropy spans of every whole text."""
    found = scanned(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _op2_sql() -> str:
    """Matches with their starts by list sums; entropy by counting the characters of every window."""
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [("assign", f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]
    kinds += [(c.kind, c.pattern, 0, c.window) for c in CLASSES]
    found = " UNION ALL ".join(f"SELECT row, doc_id, {n} AS kind_no, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS part, string_split_regex(t, '{p}') AS gaps FROM d" for n, (kind, p, g, least) in enumerate(kinds))
    width = " ".join(f"WHEN kind_no = {3 + n} THEN {c.window}" for n, c in enumerate(CLASSES))
    most = " ".join(f"WHEN kind_no = {3 + n} THEN {math.floor((math.log2(c.window) - c.bits) * c.window * 1e6)}" for n, c in enumerate(CLASSES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT row, kind_no, kind, least, m, part, gaps, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT row, kind_no, kind, m[i] AS c, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM u WHERE len(part[i]) >= least),
base AS (SELECT row, start, kind_no, start + len(c) AS stop, kind FROM s WHERE kind_no < 3),
cand AS (SELECT *, CASE {width} END AS w FROM s WHERE kind_no >= 3 AND regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '(?i)example|sample|placeholder|dummy|xxxx|0123456789|abcdefgh')
  AND NOT regexp_full_match(c, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') AND len(list_filter(range(1, len(c) - 6), lambda k: substr(c, k, 8) = repeat(substr(c, k, 1), 8))) = 0),
win AS (SELECT row, kind_no, kind, start, c, w, unnest(range(0, len(c) - w + 1)) AS o FROM cand),
ch AS (SELECT row, kind_no, kind, start, w, o, unnest(string_split(substr(c, o + 1, w), '')) AS x FROM win),
cost AS (SELECT row, kind_no, kind, start, w, o, sum(round(n * log2(n) * 1e6)) AS cost FROM (SELECT row, kind_no, kind, start, w, o, x, count(*) AS n FROM ch GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT row, q.start + min(o) AS start, kind_no, q.start + max(o) + any_value(w) AS stop, kind FROM cost q WHERE q.cost <= CASE {most} END GROUP BY row, kind_no, kind, q.start),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM hot WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = hot.row AND b.start <= hot.start AND b.stop >= hot.stop))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop), '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY d.row, d.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in four arrivals, compacted: where each row is stored."""
    return sharded(table(spark, sf_dir, "documents"), arrivals=4)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~classifier.held_out()).select("doc_id", F.col("quality").alias("label"))
    found = classifier.scored(docs, classifier.trained(docs, labels))
    return found.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document."""
    found = fingerprinted(table(spark, sf_dir, "documents")).withColumnsRenamed({"fingerprint": "own", "edited_fingerprint": "other", "next_fingerprint": "following"})
    own, edited, following = F.col("own"), F.col("other"), F.col("following")
    texts = [F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    return found.select("doc_id", *texts, written(own).alias("fingerprint"), written(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"), F.col("aligned").cast("long").alias("n_aligned"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no list and no fetch time: both are made from host names and page_ids by the rules in OP6_SQL."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.pmod(F.col("page_id") * 37, F.lit(730)).alias("day"))
    hosts = captures.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    parts = F.split("host", r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.size(parts)), ".")
    named = hosts.select("host", F.lit("host").alias("category")).union(hosts.select(domain, F.lit("domain")).distinct())
    x = named.withColumn("x", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")).filter(F.when(F.col("category") == "host", F.col("x") % 3 < 2).otherwise(F.col("x") % 4 == 0))
    turns = F.array(*[F.struct(day.cast("int").alias("day"), F.lit(listed).alias("listed")) for day, listed in ((F.col("x") % 300, True), (F.col("x") % 300 + 40 + F.col("x") % 150, False), (F.col("x") % 300 + 260 + F.col("x") % 170, True))])
    entries = x.select(F.col("host").alias("pattern"), "category", F.explode(turns).alias("t")).select("pattern", "category", "t.day", "t.listed")
    return filtered(captures, entries)


OP6_SQL = r"""
WITH c AS (
  SELECT page_id AS capture_id, CAST((page_id * 37) % 730 AS INTEGER) AS day,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.'), '') AS host
  FROM pages
), h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
named AS (
  SELECT host AS pattern, 'host' AS category FROM h
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 2, 1):], '.'), 'domain' FROM h
), x AS (
  SELECT *, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS x FROM named
), listed AS (
  SELECT * FROM x WHERE CASE WHEN category = 'host' THEN x % 3 < 2 ELSE x % 4 = 0 END
), valid AS (
  SELECT pattern, category, x % 300 AS since, x % 300 + 40 + x % 150 AS until FROM listed
  UNION ALL SELECT pattern, category, x % 300 + 260 + x % 170, 1000000 FROM listed
), asked AS (
  SELECT host, string_split(host, '.') AS p, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM h
), keys AS (SELECT host, array_to_string(p[i:], '.') AS pattern FROM asked),
m AS (
  SELECT capture_id, count(*) AS n, string_agg(pattern || ':' || category || ':' || since, ',' ORDER BY pattern || ':' || category || ':' || since) AS matches
  FROM c JOIN keys USING (host) JOIN valid USING (pattern) WHERE since <= day AND day < until GROUP BY capture_id
)
SELECT capture_id, host, day, coalesce(n, 0) AS n_active, coalesce(matches, '') AS matches, coalesce(n, 0) > 0 AS blocked FROM c LEFT JOIN m USING (capture_id)
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1,024 tokens."""
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end=2)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that any 400-byte string covers which starts elsewhere too; has_repeats tells whether any went."""
    found = without_repeats(table(spark, sf_dir, "documents"), length=400)
    kept = F.octet_length("kept").cast("long")
    removed = F.col("n_bytes") - kept
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT row, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT row, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
hit AS (SELECT row, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
cut AS (SELECT row, min(i) AS a, max(i) + 400 AS z FROM (SELECT row, i, sum(opens) OVER (PARTITION BY row ORDER BY i) AS run FROM (SELECT row, i, CASE WHEN i > lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 1 ELSE 0 END AS opens FROM hit)) GROUP BY row, run),
part AS (SELECT row, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS a, a AS z FROM cut UNION ALL SELECT row, max(z), NULL FROM cut GROUP BY row UNION ALL SELECT row, 0, NULL FROM d WHERE row NOT IN (SELECT row FROM cut)),
kept AS (SELECT row, string_agg(CASE WHEN coalesce(z, octet_length(b)) > a THEN hex(b[a + 1:coalesce(z, octet_length(b))]) ELSE '' END, '' ORDER BY a) AS x FROM part JOIN d USING (row) GROUP BY row)
SELECT d.doc_id, octet_length(b) AS n_bytes, octet_length(b) - len(x) // 2 AS n_removed, coalesce(c.n, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256, octet_length(b) > len(x) // 2 AS has_repeats
FROM d JOIN kept USING (row) LEFT JOIN (SELECT row, count(*) AS n FROM cut GROUP BY row) c USING (row)
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in ten-word windows of which benchmark items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("at").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document, learnt from those that are not held out."""
    found = lm.scored(table(spark, sf_dir, "documents"), training=lm.in_training())
    return found.select("doc_id", (~lm.in_training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw))
), m AS (
  SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_secret_scan, op3_sharding, op4_quality_classifier, op5_document_fingerprints, op6_url_filters, op7_best_fit_packing, op8_repeated_passages, op9_benchmark_decontamination, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op2_secret_scan": _op2_sql(), "op6_url_filters": OP6_SQL, "op8_repeated_passages": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL}
