"""Document fingerprints from closed syncmers of words, in column expressions only.

A run of K words is chosen if the least hash of its inner runs of S words lies at its start or its end. The choice
depends on nothing outside the run, so two texts that share a passage choose the same runs within it, wherever it
stands; two texts are matched by place where they have the same run at the same word (aligned). The fingerprint is the
SKETCH least hashes of the distinct chosen runs, or all below BOUND where those are more, so it grows with the text; the
likeness of two fingerprints estimates the Jaccard similarity of their chosen runs, from the hashes that both would hold.

Scale: fingerprints need no shuffle. Documents meet their successor in ascending doc_id by one shuffle: quantiles of
doc_id cut the table into buckets of a bounded size, and the rows that open a bucket are also sent to the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Words in a run, words in an inner run, least hashes in a fingerprint.
K, S, SKETCH = 4, 2, 128
#: Under this a 32-bit hash is always held: one of 16.
BOUND = -(2**31) + 2**28
#: Characters in a run, where a text has no chosen run of words.
GRAM = 6
#: Rows in a bucket of consecutive documents on average, and most buckets: of a larger table they get longer, and sorts spill.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _inner(words: Column) -> Column:
    """Hashes of the runs of S words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    return let(h, lambda h: F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))


def _chosen(words: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(hash, place of its first word) for each closed syncmer, in order."""

    def runs(m: Column) -> Column:
        first = F.slice(m, F.lit(1), F.greatest(F.size(m) - 2, F.lit(0)))
        closed = lambda x, i: F.when(F.least(x, F.get(m, i + 2)) <= F.get(m, i + 1), made(F.xxhash64(x, F.get(m, i + 2)), i))
        return F.filter(F.transform(first, closed), lambda x: x.isNotNull())

    return let(_inner(words), runs)


def anchors(text: Column) -> Column:
    """array<struct<hash, place>>: the closed syncmers of a text with the place of their first word, for positional matching."""
    return _chosen(words_of(text), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))


def _grams(text: Column) -> Column:
    """Overlapping runs of GRAM characters."""

    def runs(c: Column) -> Column:
        first = F.slice(c, F.lit(1), F.greatest(F.size(c) - (GRAM - 1), F.lit(0)))
        return F.transform(first, lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, GRAM)]))

    return let(F.split(text, "", -1), runs)


def sketch(text: Column) -> Column:
    """The least SKETCH 32-bit hashes, and all others below BOUND, ascending; without words there is none.

    Texts of any length are taken by words, so that all can be compared. Only one without a chosen run of words gives the
    syncmers of its runs of GRAM characters; one too short for any is a single run.
    """
    none = F.array().cast("array<bigint>")

    def every(words: Column) -> Column:
        long = F.when(F.size(words) >= K, _chosen(words, lambda h, i: h)).otherwise(none)
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        either = lambda x, other: let(x, lambda x: F.when(F.size(x) > 0, x).otherwise(other))
        return F.when(F.size(words) == 0, none).otherwise(either(long, either(_chosen(_grams(text), lambda h, i: h), whole)))

    low = lambda x: F.slice(x, F.lit(1), F.greatest(F.lit(SKETCH), F.size(F.filter(x, lambda h: h < BOUND))))
    least = lambda x: let(F.sort_array(F.array_distinct(F.transform(x, lambda h: F.shiftright(h, 32).cast("int")))), low)
    return let(let(words_of(text), every), least)


def aligned(a: Column, b: Column) -> Column:
    """How many chosen runs two texts have at the same place."""
    places = lambda t: F.transform(anchors(t), lambda x: F.xxhash64(x["hash"], x["place"]))
    return F.size(F.array_intersect(places(a), places(b)))


def written(fingerprint: Column) -> Column:
    """Eight hex digits for each hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1. Two empty fingerprints are alike."""
    whole = lambda x: F.when(F.size(x) < SKETCH, F.lit(2**31 - 1)).otherwise(F.element_at(x, -1))  # noqa: E731  up to where a sketch has all
    held = lambda x, top: F.size(F.filter(x, lambda h: h <= top))
    part = let(F.least(whole(a), whole(b)), lambda top: held(F.array_intersect(a, b), top) / held(F.array_union(a, b), top))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(part)


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<c> for each of columns: those of the row that follows by doc_id, then text; the last is followed by the first.

    Rows with a null doc_id have no place in the order: each is followed by itself and follows no other, however many
    there are, so they aren't shuffled.
    """
    alone = df.filter("doc_id is null").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    df = df.filter("doc_id is not null")
    n = df.count()
    if not n:
        return alone
    key = F.col("doc_id")
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    at = [i / buckets for i in range(buckets)]
    bounds = sorted(set(df.select(F.percentile_approx(key, at, max(100_000, 4 * buckets)).alias("q"), F.min(key).alias("m")).select(F.array_union(F.array("m"), "q")).first()[0]))
    width = max(1, int(len(bounds) ** 0.5))
    every, top = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[::width]])
    block = F.size(F.filter(top, lambda b: b <= F.col("_key"))) - 1
    own = F.size(F.filter(F.slice(every, F.col("_block") * width + 1, width), lambda b: b <= F.col("_key"))) - 1
    placed = df.withColumn("_key", key).withColumn("_block", block).withColumn("_bucket", F.col("_block") * width + own)
    opens = F.get(every, F.col("_bucket")) == F.col("_key")
    both = F.when(opens, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.pmod(F.col("_bucket") - 1, F.lit(len(bounds))).alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g"))))
    dealt = placed.withColumn("_to", F.explode(both)).withColumn("_b", F.col("_to.b")).withColumn("_g", F.col("_to.g"))
    order = Window.partitionBy("_b").orderBy("_g", "_key", "text")
    led = dealt.select(*df.columns, "_g", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.filter("_g = 0").drop("_g").unionByName(alone)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, fingerprint (array), edited (the text with the last half of its
    code points replaced by as many of the next document's first, or all), edited_fingerprint, next_fingerprint, aligned
    (runs that the text and the edited text have at the same place).

    Null texts count as empty; of rows with one doc_id the order is that of their texts; a single row and one with a null
    doc_id is followed by itself; other columns are ignored.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("fingerprint", sketch(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    out = with_next(df, ["text", "fingerprint"]).withColumn("edited", edited)
    return out.select("doc_id", "text", "fingerprint", "edited", sketch(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", aligned(F.col("text"), F.col("edited")).alias("aligned"))
