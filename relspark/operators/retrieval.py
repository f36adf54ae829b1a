"""Lexical and dense retrieval, fusion of fields, ranking and pooling.

Scores are rounded to DIGITS before they are ranked, and ids break ties, so ranks don't depend on the order of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType

from ..config import ContractError
from ..functions.text import Analyzer, model_text, query_text
from ..sources.writers import write_tables

K1, B, DIGITS = 1.2, 0.75, 6
TOP, K_MAX, DEPTH = 100, 10_000, 50
#: Queries that a block may hold: as many times their vectors or terms are broadcast.
QUERY_BLOCK = 50_000
#: Queries of a lexical block; their terms times themselves is the size of its weights.
LEXICAL_BLOCK = 500
#: Documents of a product with them.
DOCUMENT_BLOCK = 256


PLAIN = Analyzer(entities=False)
#: What precedes a query that is embedded.
INSTRUCTION = "Retrieve semantically similar text"


def analysed(df: DataFrame, fields: Sequence[str], analyzer: Analyzer = PLAIN) -> DataFrame:
    """(id, fields): the terms of each field of df (id and fields)."""
    return df.select("id", *[analyzer(F.col(f)).alias(f) for f in fields])


def saturated(tf, length, mean):
    """The weight of a term that occurs tf times, for numbers and arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, queries: DataFrame, fields: Sequence[str] = ("title", "description"), analyzer: Analyzer = PLAIN, top: int | None = None) -> DataFrame:
    """(id_query, id, a score for each field, score) by Okapi BM25, both sides with saturated term weights.

    docs has unique ids and fields, queries id_query and query. score is the sum of the fields' scores, missing ones as
    0; pairs without a common term are left out. With top, at least the first `top` of each query are in the result.
    """
    return scored_terms(_searched(docs, fields, analyzer), queries, fields, analyzer, top)


def _searched(df: DataFrame, fields: Sequence[str], analyzer: Analyzer) -> DataFrame:
    """What scored_terms makes of df (id and fields): its texts, where an analyzer needs no more, else its terms."""
    return analyzer.lowered(df.select("id", *fields), fields) if analyzer.whole else analysed(df, fields, analyzer)


#: Bytes that a TOKEN of lower-case or any other text may have; À to ÿ are C3 and a second byte.
_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", 0xC3]] = True


def _tokens(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts: tokens of `least` characters or more in each, and the text and the word of every run of TOKEN, shorter
    ones too. Works on the bytes of all texts at once."""
    n, (_, offsets, data) = len(column), column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(n, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    inside, lead = _TOKEN_BYTES[raw], raw == 0xC3
    inside[1:] |= lead[:-1]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    some = ends[1:] > ends[:-1]  # a token ends with its text
    first, last = ends[:-1][some], ends[1:][some] - 1
    begins[first], stops[last] = inside[first], inside[last]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size = stop - begin
    place = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=place[1:])
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(place), pa.py_buffer(raw[inside]))
    if lead.any():
        pairs = np.cumsum(lead)
        size = size - (pairs[stop - 1] - pairs[begin] + lead[begin])
    bounds = np.searchsorted(begin, ends)
    long = np.append(0, np.cumsum(size >= least))[bounds]
    return np.diff(long), np.repeat(np.arange(n), np.diff(bounds)), words


def _known(column: pa.Array, vocabulary: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts or term lists: the terms in each; and of each term in the vocabulary, its text and its place there."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        length, text, words = _tokens(column.cast(pa.string()).fill_null("") if column.null_count else column.cast(pa.string()), least)
    else:
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        text, words = np.repeat(np.arange(len(length)), length), column.flatten().cast(pa.string())
    at = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    met = np.flatnonzero(at >= 0)
    return length, text[met], at[met]


def _term_counts(index: DataFrame, fields: Sequence[str], vocabulary: Sequence[str], least: int) -> dict[str, tuple[int, float, np.ndarray]]:
    """Per field: documents, mean length and the document frequency of each term of the vocabulary, by one pass of which
    each task returns one row for a field and term that it met."""
    size = len(vocabulary)
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        total = np.zeros((len(fields), size + 2), np.int64)
        for b in it:
            for at in range(0, b.num_rows, DOCUMENT_BLOCK):
                part = b.slice(at, DOCUMENT_BLOCK)
                for f in range(len(fields)):
                    length, text, term = _known(part.column(f), words, least)
                    total[f, -2] += len(length)
                    total[f, -1] += length.sum()
                    met = np.zeros((len(length), size), bool)
                    met[text, term] = True
                    total[f, :size] += met.sum(0)
        f, i = np.nonzero(total)
        yield pa.record_batch([pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(total[f, i])], ["field", "place", "n"])

    total = np.zeros((len(fields), size + 2), np.int64)
    for r in index.select(*fields).mapInArrow(run, "field int, place int, n long").groupBy("field", "place").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r.field, r.place] = r.n
    return {f: (int(n[-2]), n[-1] / n[-2] if n[-2] else 0.0, n[:-2]) for f, n in zip(fields, total, strict=True)}


def _best(query: np.ndarray, score: np.ndarray, top: int, least: np.ndarray) -> np.ndarray:
    """Places of each query's first `top` rounded scores and of those that tie with the last; least becomes what a further
    score of a query must reach."""
    order = np.lexsort((-score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    size = np.diff(np.append(first, len(q)))
    edge = score[order][first + np.minimum(top, size) - 1]
    full = size >= top
    least[q[first][full]] = edge[full]
    return order[score[order] >= np.repeat(edge, size)]


def scored_terms(index: DataFrame, queries: DataFrame, fields: Sequence[str] = ("title", "description"), analyzer: Analyzer = PLAIN, top: int | None = None) -> DataFrame:
    """bm25 over documents (id, fields), analysed to term lists by a plan or in a stored index, or lowered by an analyzer
    that is `whole`, whose tokens are then found in the bytes of the texts.

    Each block of documents is a product of its weights with those of a block of at most LEXICAL_BLOCK queries,
    field by field, and fields are summed there, so a common term costs arithmetic and not a row for each document and
    query that share it. With `top`, a task passes on little more than `top` rows for each query, so what is shuffled
    for the ranking is bounded by tasks x queries x top, whatever the corpus.
    """
    spark, n, least = index.sparkSession, queries.count(), analyzer.least
    id_type, query_type = (to_arrow_type(x) for x in (index.schema["id"].dataType, queries.schema["id_query"].dataType))
    columns = [f"{f}_score" for f in fields] + ["score"]
    schema = f"id_query {queries.schema['id_query'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns)
    asked, out = queries.select("id_query", analyzer(F.col("query")).alias("terms")), None
    blocks = max(1, -(-n // LEXICAL_BLOCK))
    for k in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id_query"), F.lit(blocks)) == k)).collect()
        vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        counts = _term_counts(index, fields, [*vocabulary], least)
        weights = {}
        for f, (docs, mean, df) in counts.items():
            idf, weights[f] = np.log1p((docs - df + 0.5) / (df + 0.5)) * (df > 0), np.zeros((len(vocabulary), len(rows)))
            for j, r in enumerate(rows):
                for t, tf in Counter(r.terms).items():
                    if mean:
                        weights[f][vocabulary[t], j] = idf[vocabulary[t]] * saturated(tf, len(r.terms), mean)
        shared = spark.sparkContext.broadcast(([*vocabulary], [r.id_query for r in rows], {f: c[1] for f, c in counts.items()}, weights))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, names, means, weights = shared.value
            words, names, held = pa.array(vocabulary, pa.string()), pa.array(names, query_type), []
            edge = np.full(len(names), -np.inf)

            def passed(q: np.ndarray, ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
                return pa.record_batch([names.take(pa.array(q)), ids.cast(id_type), *[pa.array(scores[:, c].copy()) for c in range(scores.shape[1])]], ["id_query", "id", *columns])

            def pruned() -> tuple[np.ndarray, pa.Array, np.ndarray]:
                q, scores = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
                ids = pa.concat_arrays([h[1] for h in held])
                at = _best(q, scores[:, -1], top, edge)
                return q[at], ids.take(pa.array(at)), scores[at]

            for b in it:
                for at in range(0, b.num_rows if len(names) else 0, DOCUMENT_BLOCK):
                    part = b.slice(at, DOCUMENT_BLOCK)
                    scores = np.zeros((len(fields) + 1, part.num_rows, len(names)))
                    for f, field in enumerate(fields):
                        length, text, term = _known(part.column(1 + f), words, least)
                        if len(term):
                            met = np.zeros(len(words), bool)
                            met[term] = True
                            used = np.flatnonzero(met)
                            place = np.zeros(len(words), np.int64)
                            place[used] = np.arange(len(used))
                            tf = np.bincount(text * len(used) + place[term], minlength=len(length) * len(used))
                            some = np.flatnonzero(tf)
                            weight = np.zeros(len(tf))
                            weight[some] = saturated(tf[some].astype(float), length[some // len(used)], means[field])
                            scores[f] = weight.reshape(len(length), len(used)) @ weights[field][used]
                    scores[-1] = np.floor(scores[:-1].sum(0) * 10**DIGITS + 0.5) / 10**DIGITS
                    i, j = np.nonzero((scores[:-1] != 0).any(0) & (scores[-1] >= edge))
                    if not len(i):
                        continue
                    found = j, part.column(0).take(pa.array(i)), scores[:, i, j].T
                    if top is None:
                        yield passed(*found)
                        continue
                    held.append(found)
                    if sum(len(h[0]) for h in held) > max(200_000, 4 * top * len(names)):
                        held = [pruned()]
            if held:
                yield passed(*pruned())

        hits = index.select("id", *fields).mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def fused(scores: DataFrame, fields: Sequence[str] = ("title", "description")) -> DataFrame:
    """(id_query, id, score): the sum over fields of the best score, negative ones as 0, missing ones as 0. One shuffle, no outer join."""
    best = [F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("field") == f, F.col("score"))), F.lit(0.0))).alias(f"{f}_score") for f in fields]
    out = scores.groupBy("id_query", "id").agg(*best)
    return out.withColumn("score", F.round(sum((F.col(f"{f}_score") for f in fields[1:]), F.col(f"{fields[0]}_score")), DIGITS))


def ranked(scores: DataFrame, top: int = TOP, ties: Sequence[str] = ("id",)) -> DataFrame:
    """The first `top` of each query with their rank. Spark limits groups before the shuffle."""
    order = Window.partitionBy("id_query").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def dense(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(id_query, id, score, rank) by cosine of vectors (id, vector) with queries (id_query, vector), exact.

    Queries are broadcast in blocks of at most QUERY_BLOCK; each Arrow batch is one matrix product and passes on no
    more than `top` rows for a query, so the shuffle doesn't grow with the product of both sides. Zero vectors score 0.
    """
    spark, n = vectors.sparkSession, queries.count()
    blocks, out, kind = max(1, -(-n // QUERY_BLOCK)), None, to_arrow_type(queries.schema["id_query"].dataType)
    for k in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id_query"), F.lit(blocks)) == k)
        rows = block.select("id_query", "vector").collect()
        names, matrix = [r.id_query for r in rows], np.array([r.vector for r in rows], np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True) if len(rows) else matrix
        shared = spark.sparkContext.broadcast((np.array(names), matrix / np.where(norms == 0, 1, norms) if len(rows) else matrix))

        def run(it: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in it:
                if not len(names) or not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                v = np.array(b.column(1).to_pylist(), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.round(q @ (v / np.where(norm == 0, 1, norm)).T, DIGITS)
                kth = -np.partition(-s, top - 1, axis=1)[:, top - 1 : top] if s.shape[1] > top else np.full((len(s), 1), -2.0)
                i, j = np.nonzero(s >= kth)  # ties at the edge all pass; the ranking settles them
                yield pa.record_batch([pa.array(names[i]).cast(kind), pa.array(ids[j]).cast(b.schema.field(0).type), pa.array(s[i, j])], ["id_query", "id", "score"])

        found = vectors.select("id", "vector").mapInArrow(run, f"id_query {queries.schema['id_query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, top)


def pooled(profiles: Mapping[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(id_query, id, retrieval, n_profiles, result_index): the union of each profile's first `depth`.

    retrieval maps profile to struct<rank, score>; the order is that of first occurrence, by profile and then rank.
    Union and one aggregate stand for the chain of full outer joins.
    """
    rows = None
    for n, (name, hits) in enumerate(profiles.items()):
        part = hits.filter(F.col("rank") <= depth).select("id_query", "id", F.lit(name).alias("profile"), F.lit(n).alias("profile_order"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    own = F.sort_array(F.collect_list(F.struct("profile_order", "profile", F.struct("rank", "score").alias("hit"))))
    out = rows.groupBy("id_query", "id").agg(own.alias("own"), F.min(F.struct("profile_order", "rank")).alias("first"))
    entries = F.map_from_entries(F.transform("own", lambda x: F.struct(x["profile"], x["hit"])))
    order = Window.partitionBy("id_query").orderBy("first", "id")
    return out.select("id_query", "id", entries.alias("retrieval"), F.size("own").alias("n_profiles"), (F.row_number().over(order) - 1).alias("result_index"))


def renamed_profiles(retrieval: Column, aliases: Mapping[str, str]) -> Column:
    """Map keys by their aliases; two keys that become one raise."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    return F.transform_keys(retrieval, lambda k, _: F.coalesce(F.element_at(names, k), k)) if aliases else retrieval


def payload(hits: DataFrame, fields: Sequence[str], fallbacks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Hits with each field as trimmed text: its own, the first of its fallbacks that isn't blank, or empty. Other columns stay."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    have = set(hits.columns)
    out = {f: F.coalesce(*[text(c) for c in (f, *(fallbacks or {}).get(f, ())) if c in have], F.lit("")) for f in fields}
    return hits.withColumns(out)


def memberships(pool: DataFrame) -> DataFrame:
    """(id_query, id, profile, rank, score), a row for each profile of a pooled pair."""
    return pool.select("id_query", "id", F.explode("retrieval").alias("profile", "hit")).select("id_query", "id", "profile", "hit.rank", "hit.score")


def pool_summary(members: DataFrame) -> DataFrame:
    """One row for each profile: memberships, queries that it served, and the pairs of the whole pool."""
    total = members.select("id_query", "id").distinct().agg(F.count("*").alias("pool_pairs"))
    per = members.groupBy("profile").agg(F.count("*").alias("memberships"), F.countDistinct("id_query").alias("queries"))
    return per.crossJoin(F.broadcast(total))  # one row


def query_prompt(query: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query_text(query))


class Retriever:
    """Named retrieval profiles over dataset records (id and fields), each searched field by field and fused.

    A lexical profile has an Analyzer, a dense one a function from texts to vectors, which Arrow batches are put
    through. build() writes each profile's index as Parquet and open() reads it back; without an index the plan starts
    at the records.
    """

    ALIASES = {"lexical": "bm25"}

    def __init__(self, records: DataFrame, fields: Sequence[str] = ("title", "description")):
        self.records, self.fields = records, list(fields)
        self.lexical: dict[str, Analyzer] = {}
        self.encoders: dict[str, Callable[[list[str]], list[list[float]]]] = {}
        self.stored: dict[str, DataFrame] = {}

    def add(self, name: str, how: Analyzer | Callable[[list[str]], list[list[float]]]) -> Retriever:
        name = self.ALIASES.get(name, name)
        if name in self.lexical or name in self.encoders:
            raise ContractError(f"profile {name} is there already")
        (self.lexical if isinstance(how, Analyzer) else self.encoders)[name] = how
        return self

    def _vectors(self, df: DataFrame, key: str, text: Column, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
        embed = F.pandas_udf(lambda s: pd.Series(list(encoder(s.tolist()))), ArrayType(DoubleType()))
        return df.withColumn("vector", embed(text)).select(key, *[c for c in ("field",) if c in df.columns], "vector")

    def index(self, name: str) -> DataFrame:
        """(id, fields as term lists) or (id, field, vector)."""
        name = self.ALIASES.get(name, name)
        if name in self.stored:
            return self.stored[name]
        if name in self.lexical:
            return analysed(self.records, self.fields, self.lexical[name])
        if name not in self.encoders:
            raise ContractError(f"there is no profile {name}")
        rows = self.records.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in self.fields])).alias("r")).select("id", "r.field", model_text(F.col("r.text")).alias("text"))
        return self._vectors(rows, "id", F.col("text"), self.encoders[name])

    def build(self, path: str, overwrite: bool = False) -> None:
        for name in [*self.lexical, *self.encoders]:
            write_tables(self.index(name), f"{path}/{name}", overwrite)

    def open(self, path: str) -> Retriever:
        spark = self.records.sparkSession
        self.stored = {name: spark.read.parquet(f"{path}/{name}") for name in [*self.lexical, *self.encoders]}
        return self

    def search(self, name: str, queries: DataFrame, top: int = TOP) -> DataFrame:
        """(id_query, id, field scores, score, rank) of queries (id_query, query)."""
        name = self.ALIASES.get(name, name)
        if name in self.lexical:
            how = self.lexical[name]
            index = self.stored[name] if name in self.stored else _searched(self.records, self.fields, how)
            return ranked(scored_terms(index, queries, self.fields, how, top), top)
        index = self.index(name)
        asked = self._vectors(queries.select("id_query", query_prompt(F.col("query")).alias("text")), "id_query", F.col("text"), self.encoders[name])
        parts = [dense(index.filter(F.col("field") == f), asked, K_MAX).withColumn("field", F.lit(f)).drop("rank") for f in self.fields]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return ranked(fused(rows, self.fields), top)

    def pool(self, names: Sequence[str], queries: DataFrame, depth: int = DEPTH) -> DataFrame:
        return pooled({n: self.search(n, queries) for n in names}, depth)
