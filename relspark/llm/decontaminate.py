"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A window is a run of `window` item words (all of an item that has fewer). An exact match contains every word of the
window, so its necessary prefix is a single word: the rarest of the window in the corpus. Occurrences of such words are
the only candidates; a candidate fixes how the item lies over the document (the positional bound), and the words
around it are compared exactly, at most window - 1 to each side. Nothing of the documents is shuffled.

Scale: the benchmark is a stated query set. It is cut into blocks of at most BLOCK_WORDS words, each of which is
broadcast, and documents pass through the blocks one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, sliced, text_of

BLOCK_WORDS = 2_000_000
#: Word bytes after lower-casing: 0-9, a-z and all of characters outside ASCII; others separate words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Block:
    """Some items, ready to be found: their words' ids, and the (word, place in items) of each window's rarest word."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        parts, owner = [np.full(window, -3, np.int32)], [np.full(window, -1)]
        self.sizes = [len(words) for _, words in items]
        self.starts = (window + np.concatenate(([0], np.cumsum([n + 1 for n in self.sizes])))).tolist()
        for k, (_, words) in enumerate(items):
            parts += [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int32), np.full(1, -3, np.int32)]
            owner += [np.full(len(words), k), np.full(1, -1)]
        parts.append(np.full(window, -3, np.int32))
        self.flat = np.concatenate(parts)
        self.owner = np.concatenate([*owner, np.full(window, -1)])
        self.need = np.array([min(window, len(w)) for _, w in items] or [0])

    def anchor(self, counts: np.ndarray) -> None:
        places = set()
        for at, n in zip(self.starts, self.sizes, strict=False):
            size = min(n, self.window)
            rank = [(int(counts[w]), q) for q, w in enumerate(self.flat[at : at + n].tolist())]
            places |= {at + min(rank[s : s + size])[1] for s in range(n - size + 1)}
        at = np.array(sorted(places), np.int64)
        at = at[np.argsort(self.flat[at], kind="stable")] if len(at) else at
        self.places, self.count = at, np.bincount(self.flat[at], minlength=len(self.vocab) + 1) if len(at) else np.zeros(len(self.vocab) + 1, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bounds of documents in a flat array, flat hit flags, document and item index of each match)."""
        w, get = self.window, self.vocab.get
        n = np.array([len(d) for d in docs])
        begin = w + np.concatenate(([0], np.cumsum(n + 1)))
        ids = np.full(int(begin[-1]) + w, -2, np.int32)
        for d, at in zip(docs, begin.tolist(), strict=False):  # begin has one more
            ids[at : at + len(d)] = np.fromiter(map(get, d, repeat(-1)), np.int32, len(d))
        p = np.flatnonzero(ids >= 0)
        p = p[self.count[ids[p]] > 0]
        times = self.count[ids[p]]
        at = np.repeat(self.first[ids[p]] - np.concatenate(([0], np.cumsum(times)))[:-1], times) + np.arange(int(times.sum()))
        p, q = np.repeat(p, times), self.places[at]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for run, step in ((right, 1), (left, -1)):
            on = np.arange(len(p))
            for i in range(1, w):
                on = on[ids[p[on] + step * i] == self.flat[q[on] + step * i]]
                run[on] = i
        item = self.owner[q]
        full = left + right + 1 >= self.need[item]
        p, item, left, right = p[full], item[full], left[full], right[full]
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, p - left, 1)
        np.add.at(change, p + right + 1, -1)
        doc = np.searchsorted(begin, p, "right") - 1
        both = np.unique(doc * (len(self.names) + 1) + item)
        return begin, np.cumsum(change) > 0, both // (len(self.names) + 1), both % (len(self.names) + 1)


def counted(docs: DataFrame, vocab: dict[bytes, int]) -> np.ndarray:
    """How often each word of vocab occurs in all documents."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, get = np.zeros(len(words.value) + 1, np.int64), words.value.get
        for b in sliced(it):
            found = [w for text in b.column(0).to_pylist() for w in words_of(text)]
            total += np.bincount(np.fromiter(map(get, found, repeat(len(total) - 1)), np.int64, len(found)), minlength=len(total))
        seen = np.flatnonzero(total[:-1])
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    out = np.zeros(len(vocab), np.int64)
    for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.word] = r.n
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, n_words, at (sorted places of the words that are in an
    occurring window) and items (sorted distinct item_ids with occurring windows).

    Null texts have no words, and items without words match nothing. An item with a null item_id marks hits but is
    not among items; several rows of one item_id are one item. Repeated documents stay repeated. Other columns are
    ignored but for those of carry, which come last as c0, c1 ...; with an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    more = [F.col(x).alias(f"c{i}") for i, x in enumerate(carry or [])]
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *more)
    types = "".join(f", c{i} {docs.schema[x].dataType.simpleString()}" for i, x in enumerate(carry or []))
    items = benchmark.select("item_id", text_of().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * BLOCK_WORDS)))
    out = df.select("doc_id", "text", F.lit(-1).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("at"), F.expr("cast(array() as array<long>)").alias("items"), *df.columns[2:])
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).distinct().collect()
        split = [(r.item_id, words_of(r.text)) for r in rows]
        block = Block([x for x in split if x[1]], window)
        block.anchor(counted(df, block.vocab))
        shared = spark.sparkContext.broadcast(block)

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            block, docs = shared.value, [words_of(x) for x in b.column(1).to_pylist()]
            begin, hit, doc, item = block.find(docs)
            at, names = [], [set(x) for x in b.column(4).to_pylist()]
            for k, old in enumerate(b.column(3).to_pylist()):
                new = np.flatnonzero(hit[begin[k] : begin[k] + len(docs[k])])
                at.append(np.union1d(old, new) if old else new)
            for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                if block.names[i] is not None:
                    names[d].add(block.names[i])
            n = pa.array([len(d) for d in docs], pa.int64())
            return pa.record_batch([b.column(0), b.column(1), n, pa.array(at, pa.list_(pa.int32())), pa.array([sorted(x) for x in names], pa.list_(pa.int64())), *b.columns[5:]], b.schema.names)

        out = batches(out, run, "doc_id long, text string, n_words long, at array<int>, items array<long>" + types)
    return out
