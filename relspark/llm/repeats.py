"""Removal of long repeated byte strings, found by prefix-free parsing.

A rolling hash of PHRASE bytes starts a phrase wherever it falls under a threshold, so equal text is cut at equal
places wherever it stands. Every window of `length` bytes is named by the first phrase that starts in it and by its
distance to that start; equal windows have equal names. The windows of a phrase start are one row, not one each: its
key is the hash of the bytes that all of them contain (what follows in the parse, to the depth that matters), its
context the hash of the bytes that any of them contains. Ordering the rows of the whole corpus by key and context puts
equal ones side by side, as the suffix arrays of dictionary and parse would; only the order of different ones is that
of hashes, not of bytes. Rows with equal context settle all their windows at once. Where a key meets several contexts
(at the ends of a repeated passage), one row of each context gives its windows' own hashes, and those are compared.

Scale: equal rows of a task are merged before the shuffle; two places of each are compared, the others are settled
already and dealt out evenly, so a passage or line of any frequency sends a row from each task to one place. About one
row of 32 bytes for 40 bytes of text is shuffled, sorted and read once as a stream, so a key of any frequency needs no
memory, and no pair is made. Settled places go to their texts in cells, one for each task and bucket of rows; a task
holds the places of one bucket, 16 bytes each, while its texts are read. Texts are worked on in chunks, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, sliced, stored, text_of
from .words import mix

#: Bytes under the rolling hash, bytes of text for each phrase on average, and most windows in a row.
PHRASE, EVERY, BAND = 12, 64, 80
#: Bytes of texts that are hashed at once, so that the arrays stay in a core's cache.
CHUNK = 1 << 17
#: Texts are shuffled as zstd.
ZSTD = pa.Codec("zstd", compression_level=1)
BASE = 0x9E3779B97F4A7C15
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(BASE))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i under 2**bits."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        for k in range(bits):
            p = np.concatenate((p, p * np.uint64(pow(b, 1 << k, 1 << 64))))
        out.append(p)
    return out[0], out[1]


class Hashes:
    """Hashes of any substrings of a text: sums of byte values times powers of BASE, modulo 2**64."""

    def __init__(self, text: bytes):
        n = len(text)
        powers, self.inverse = _powers(max(17, n.bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[np.frombuffer(text, np.uint8)] * powers[:n], dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def triggers(self) -> np.ndarray:
        """Where PHRASE bytes have a hash under the threshold; the upper bits of the sums are enough for that."""
        n = max(len(self.sums) - PHRASE, 0)
        return np.flatnonzero((self.sums[PHRASE:] - self.sums[:n]) * self.inverse[:n] < np.uint64((1 << 64) // EVERY))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about CHUNK bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each, so many each."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def window_rows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, text, first window, how many windows) of each row of texts of `length` bytes or more."""
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    begin, last = end - size, end - length
    h = Hashes(b"".join(texts))
    starts = h.triggers()
    text = np.searchsorted(end, starts, "right")
    whole = starts + PHRASE <= end[text]
    starts, text = starts[whole], text[whole]
    reach = length - PHRASE  # the first phrase start must be this near to be wholly inside
    before = np.concatenate(([-1], starts[:-1])) if len(starts) else starts
    before = np.maximum(before, begin[text] - 1)
    low = np.maximum(before + 1, starts - reach)
    high = np.minimum(starts, last[text])
    bands = np.arange(-(-(reach + 1) // BAND))
    core = (starts[:, None] - BAND * bands).ravel()
    lo = np.maximum(np.repeat(low, len(bands)), core - BAND + 1)
    hi = np.minimum(np.repeat(high, len(bands)), core)
    on = np.flatnonzero(lo <= hi)
    core, lo, hi, band, of = core[on], lo[on], hi[on], on % len(bands), text[on // len(bands)]
    key = mix(h(core, core + length - BAND + 1) + band.astype(np.uint64))
    context = mix(h(lo, hi + length) + (core - lo).astype(np.uint64) * np.uint64(BASE))
    latest = begin - 1
    latest[text] = starts  # the last one of each text stays
    first = np.concatenate((before, latest)) + 1  # windows in which no phrase starts: before a start's reach, after the last
    stop = np.concatenate((np.minimum(starts - reach - 1, last[text]), last))
    n = np.maximum(stop - first + 1, 0)
    bare, bare_of = _ranges(first, n), np.repeat(np.concatenate((text, np.arange(len(texts)))), n)
    own = mix(h(bare, bare + length) + np.uint64(77))
    of = np.concatenate((of, bare_of))
    return np.concatenate((key, own)).view(np.int64), np.concatenate((context, own)).view(np.int64), of, np.concatenate((lo, bare)) - begin[of], np.concatenate((hi - lo + 1, np.ones(len(bare), np.int64)))


def _packed(texts: list[bytes]) -> list[bytes]:
    return [ZSTD.compress(t, asbytes=True) for t in texts]


def _unpacked(texts: list[bytes], sizes: list[int]) -> list[bytes]:
    return [ZSTD.decompress(t, n, asbytes=True) for t, n in zip(texts, sizes, strict=True)]


def _named(docs: DataFrame, packed: bool = False) -> DataFrame:
    """(doc_id, row, n_bytes, text as bytes, or as zstd of them): row is a hash of doc_id and text, so that any task finds
    the same name."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        rows = [xxhash.xxh3_64_intdigest(t, 0 if d is None else (d + 1) % 2**64) - 2**63 for d, t in zip(b.column(0).to_pylist(), texts, strict=True)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        texts = _packed(texts) if packed else texts
        return pa.record_batch([b.column(0), pa.array(rows, pa.int64()), sizes, pa.array(texts, pa.binary())], ["doc_id", "row", "n_bytes", "text"])

    return batches(docs, run, "doc_id long, row long, n_bytes long, text binary")


#: Where windows stand: the row, and as one number the first of them, how many, and whether they are open.
PLACE = np.dtype([("row", "<i8"), ("at", "<i8")])
#: A window's own hash and where it starts.
OWN = np.dtype([("key", "<i8"), ("first", "<i8")])
#: Rows that a task holds before it merges those with equal key and context, and places in a row that is done.
HELD, PLACES = 300_000, 4_096
#: Makes Spark delete the shuffle files of a table that is written, instead of some time after the driver forgets it.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Buckets of rows, at least: a task's settled places travel in one cell for each.
BUCKETS = 1_024
#: Cells of places that are unpacked at once.
CELLS = 256
#: Columns of texts that have met their places.
MET = ["doc_id", "row", "n_bytes", "spans", "text", "full", "own"]


def _at(first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return first.astype(np.int64) << 17 | n << 1


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive values as binary cells of so many each."""
    offsets = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _merged(it: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(key, context, row, at, done): two places at most of each key and context of a task. The others need no
    comparison, as their windows stand elsewhere: they come in rows of up to PLACES, which are done and have a key that
    deals them out evenly, so a passage of any frequency has two places from each task under its key."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def merge() -> pa.RecordBatch:
        key, context, row, at = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(context ^ (key << 1))
        key, context, row, at = key[order], context[order], row[order], at[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])))
        nth = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
        some, rest = np.flatnonzero(nth < 2), np.flatnonzero(nth >= 2)
        places = np.empty(len(rest), PLACE)
        places["row"], places["at"] = row[rest], at[rest]
        cut = np.arange(0, len(rest), PLACES)
        dealt = mix(places["row"][cut].view(np.uint64) + places["at"][cut].view(np.uint64)).view(np.int64)
        none = np.zeros(len(cut), np.int64)
        cells = pa.concat_arrays([pa.nulls(len(some), pa.binary()), _binary(places, np.diff(cut, append=len(rest)))])
        return pa.record_batch([pa.array(np.concatenate(c)) for c in ((key[some], dealt), (context[some], none), (row[some], none), (at[some], none))] + [cells], ["key", "context", "row", "at", "done"])

    for rows in it:
        held.append(rows)
        if sum(len(x[0]) for x in held) >= HELD:
            yield merge()
    if held:
        yield merge()


MERGED = "key long, context long, row long, at long, done binary"


def _merged_rows(named: DataFrame, length: int) -> DataFrame:
    """The rows of all texts, equal ones of a task merged."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for b in sliced(it):
                row, texts = b.column(1).to_numpy(), b.column(3).to_pylist()
                for i, k in _chunks(texts):
                    key, context, of, first, n = window_rows(texts[i:k], length)
                    yield key, context, row[i:k][of], _at(first, n)

        return _merged(rows())

    return named.mapInArrow(run, MERGED)


def _merged_windows(own: DataFrame) -> DataFrame:
    """The open windows of all texts by their own hashes, equal ones of a task merged."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for b in sliced(it):
                cells = b.column(1).to_pylist()
                x = np.frombuffer(b"".join(cells), OWN)
                yield x["key"], x["key"], np.repeat(b.column(0).to_numpy(), [len(c) // OWN.itemsize for c in cells]), _at(x["first"], 1)

        return _merged(rows())

    return own.mapInArrow(run, MERGED)


def _settled(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, full): places whose windows all stand elsewhere too, and one open place for each context of a key that
    has several, those of a task in one cell for each bucket of rows."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "context")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((4, 0), np.int64)  # what the next batch may meet: the last row and the first of its context
        held: list[np.ndarray] = []

        def cells() -> pa.RecordBatch:
            places = np.concatenate(held)
            held.clear()
            bucket = places["row"] % buckets
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            return pa.record_batch([pa.array(bucket[first]), _binary(places[order], np.diff(first, append=len(bucket)))], ["bucket", "full"])

        for b in it:
            done = b.column(4)
            if done.null_count < len(done):
                full = done.drop_null()
                for i in range(0, len(full), CELLS):
                    held.append(np.frombuffer(b"".join(full.slice(i, CELLS).to_pylist()), PLACE))
                    if sum(map(len, held)) >= HELD:
                        yield cells()
                b = b.filter(done.is_null())
            if b.num_rows:
                key, context, row, at = np.concatenate((kept, [b.column(i).to_numpy() for i in range(4)]), axis=1)
                alike, same = np.zeros(len(key) + 1, bool), np.zeros(len(key) + 1, bool)
                alike[1:-1] = key[1:] == key[:-1]
                same[1:-1] = alike[1:-1] & (context[1:] == context[:-1])
                first = np.flatnonzero(~same[:-1])
                full = np.flatnonzero(same[:-1] | same[1:])
                several = first[alike[first] | alike[np.append(first[1:], len(key))]]
                places = np.empty(len(full) + len(several), PLACE)
                places["row"] = np.concatenate((row[full], row[several]))
                places["at"] = np.concatenate((at[full], at[several] | 1))
                held.append(places)
                keep = sorted({int(first[-1]), len(key) - 1})
                kept = np.array([key[keep], context[keep], row[keep], at[keep]])
            if sum(map(len, held)) >= HELD:
                yield cells()
        if sum(map(len, held)):
            yield cells()

    return dealt.mapInArrow(run, "bucket long, full binary")


def _cut(texts: list[bytes], of: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
    """Per text, bounds of its removed runs (start, end, start, end ...) and its other bytes; of, first, n: windows that
    go. A byte that stays is put after each text, so that no run goes on in the next one."""
    size = np.array([len(t) for t in texts])
    stop = np.cumsum(size + 1)
    begin = stop - size - 1
    start = begin[of] + first
    change = np.bincount(start, minlength=stop[-1] + 1) - np.bincount(start + n + length - 1, minlength=stop[-1] + 1)
    on = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(on, prepend=False))
    whose = np.searchsorted(stop, edges, "right")
    spans = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(texts))))).astype(np.int32), pa.array((edges - begin[whose]).astype(np.int32)))
    gone = np.bincount(whose[::2], edges[1::2] - edges[::2], len(texts)).astype(np.int64)
    on[stop - 1] = True
    return spans, _binary(np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)[~on], size - gone)


def _met(texts: DataFrame, settled: DataFrame, length: int, buckets: int) -> DataFrame:
    """MET for each of the packed texts, as its places (those settled and its `full`) say. Where some of them are open,
    own has its open windows' hashes (a further copy of a row has none), full the other places, and text is still packed;
    else own is null and text is cut."""
    beside = texts.select(F.pmod("row", F.lit(buckets)).alias("bucket"), "row", "doc_id", "n_bytes", "text", "full")
    none = [F.lit(None).cast(t).alias(c) for c, t in beside.dtypes[1:5]]
    dealt = beside.union(settled.select("bucket", *none, "full")).repartition("bucket").sortWithinPartitions("bucket", F.col("row").asc_nulls_first())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, latest = np.empty(0, PLACE), None  # places of the last bucket, by row
        for b in it:
            if not b.num_rows:
                continue
            bucket, is_text = b.column(0)[-1].as_py(), b.column(4).is_valid()
            places = kept
            if is_text.false_count:
                places = np.concatenate((kept, np.frombuffer(b"".join(b.column(5).filter(pc.invert(is_text)).to_pylist()), PLACE)))
                places = places[np.argsort(places["row"])]
            b, kept = b.filter(is_text), places[places["row"] % buckets == bucket]
            if not b.num_rows:
                continue
            packed, names, more = b.column(4).to_pylist(), b.column(1).to_numpy(), b.column(5).to_pylist()
            copy = np.append(names[0] == latest, names[1:] == names[:-1])
            latest = names[-1]
            texts = _unpacked(packed, b.column(3).to_pylist())
            for i, k in _chunks(texts):
                low, high = (np.searchsorted(places["row"], names[i:k], side) for side in ("left", "right"))
                old = [np.frombuffer(x or b"", np.int64) for x in more[i:k]]
                at = np.concatenate((places["at"][_ranges(low, high - low)], *old))
                of = np.concatenate((np.repeat(np.arange(k - i), high - low), np.repeat(np.arange(k - i), [len(x) for x in old])))
                first, n, is_open = at >> 17, (at >> 1) & 0xFFFF, (at & 1).astype(bool)
                closed = ~is_open
                spans, cut = _cut(texts[i:k], of[closed], first[closed], n[closed], length)
                docs, rows, sizes = (b.column(c).slice(i, k - i) for c in (2, 1, 3))
                waits = np.zeros(k - i, bool)
                waits[of[is_open]] = True
                if not waits.any():
                    none = pa.nulls(k - i, pa.binary())
                    yield pa.record_batch([docs, rows, sizes, spans, cut, none, none], MET)
                    continue
                full, own, whole = [None] * (k - i), [None] * (k - i), cut.to_pylist()
                by = np.argsort(of, kind="stable")
                of, at, first, n, is_open = of[by], at[by], first[by], n[by], is_open[by]
                for j in np.flatnonzero(waits).tolist():
                    own_places = slice(*np.searchsorted(of, (j, j + 1)))
                    on = is_open[own_places]
                    full[j] = at[own_places][~on].tobytes()
                    own[j], whole[j] = b"", packed[i + j]
                    if copy[i + j]:
                        continue
                    window = np.unique(_ranges(first[own_places][on], n[own_places][on]))
                    x = np.empty(len(window), OWN)
                    x["key"], x["first"] = Hashes(texts[i + j])(window, window + length).view(np.int64), window
                    own[j] = x.tobytes()
                yield pa.record_batch([docs, rows, sizes, spans, pa.array(whole, pa.binary()), pa.array(full, pa.binary()), pa.array(own, pa.binary())], MET)

    return dealt.mapInArrow(run, "doc_id long, row long, n_bytes long, spans array<int>, text binary, full binary, own binary")


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, spans (array of removed byte runs: start, end, start, end ...)
    and kept (the other bytes, in order).

    A byte goes if it is within a string of `length` bytes that also starts anywhere else in the texts, whichever
    copy. Null texts are empty; repeated rows count as further copies; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_bytes = F.octet_length("text").cast("long")
    short = texts.filter(n_bytes < length).select("doc_id", n_bytes.alias("n_bytes"), F.array().cast("array<int>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    long, spark = texts.filter(n_bytes >= length), docs.sparkSession
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    first = _named(long, packed=True).withColumn("full", F.lit(None).cast("binary"))
    cleans = spark.conf.get(CLEANS, None)
    spark.conf.set(CLEANS, "true")
    try:
        met = stored(_met(first, _settled(_merged_rows(_named(long), length), buckets), length, buckets), "met")
    finally:
        spark.conf.unset(CLEANS) if cleans is None else spark.conf.set(CLEANS, cleans)
    some = met.filter(F.col("own").isNotNull())
    rest = _met(some, _settled(_merged_windows(some.select("row", "own")), buckets), length, buckets)
    result = [x.select("doc_id", "n_bytes", "spans", F.col("text").alias("kept")) for x in (met.filter("own is null"), rest)]
    return short.union(result[0]).union(result[1])
