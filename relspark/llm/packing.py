"""Best-fit packing of tokenized documents by linear grouping.

Lengths are whole numbers of at most `size`, so the corpus is a histogram of `size` counts however many documents
there are, and the plan is made from it alone. Large lengths are put in groups of equal cardinality and rounded up to
the longest of their group; configurations of the few rounded sizes are chosen; the documents then take the places of
their group in order of length, which leaves more room than planned; small ones go best-fit into what is left. A piece
finds its place by its rank within its length: a plan row covers a run of ranks. No document reaches the driver.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small_or_shuffled, stored, text_of

#: Fixed value: how the byte-level tokenizer cuts a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """ids of a text by the tokenizer file at path, without special tokens.

    A byte-level file whose merges make ids in ascending order is run by tiktoken, which then gives the same ids at
    four times the speed. Texts that hold an added token, and other files, go to tokenizers.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    model, pre, added = kind["model"], kind.get("pre_tokenizer") or {}, [x["content"] for x in kind.get("added_tokens", [])]
    vocab = model.get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if not (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer") and made == sorted(made) and len(set(made)) == len(made)):
        return slow
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if any(x in text for x in added) else fast.encode_ordinary(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int | None = 2, with_ids: bool = False) -> DataFrame:
    """Documents as token ids, then `end`, cut from the back so that only the first piece may be shorter than size.

    part and nth number the pieces of a length within a task; with_ids adds the ids themselves.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in sliced(it):
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text) + ([] if end is None else [end]), "<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) else []
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:z].tobytes()
                    for to, x in zip(rows, (doc, k, a, z - a, zlib.crc32(own), part, int(seen[z - a]), own), strict=False):
                        to.append(x)
                    seen[z - a] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=False)], names[: len(rows)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def configurations(counts: dict[int, int], size: int, groups: int, small: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(how often, [(group size, first rank in group, group)...]) for the lengths from `small` on.

    Greedy over configurations: the largest size left takes the fullest company that fits, as often as counts allow.
    """
    total, lengths = sum(counts.values()), sorted(counts, reverse=True)
    share = max(1, -(-total // groups))
    left, sizes, k = [], [], 0
    for length in lengths:
        n = counts[length]
        while n:
            if not left or left[-1] == share:
                left.append(0)
                sizes.append(length)
            take = min(n, share - left[-1])
            left[-1] += take
            n -= take
    used, out = [0] * len(left), []

    def best(room: int, at: int, taken: dict[int, int]) -> tuple[int, list[int]]:
        top: tuple[int, list[int]] = (0, [])
        for g in range(at, len(left)):
            if sizes[g] > room or left[g] - taken.get(g, 0) <= 0:
                continue
            if room - sizes[g] < small:
                return max(top, (sizes[g], [g]))
            more = best(room - sizes[g], g, taken | {g: taken.get(g, 0) + 1})
            top = max(top, (sizes[g] + more[0], [g, *more[1]]))
        return top

    while k < len(left):
        if not left[k]:
            k += 1
            continue
        chosen = [k, *best(size - sizes[k], k, {k: 1})[1]]
        uses = {g: chosen.count(g) for g in chosen}
        often = min(left[g] // n for g, n in uses.items())
        slots = []
        for g in chosen:
            slots.append((sizes[g], used[g], g))
            used[g] += often
            left[g] -= often
        out.append((often, slots))
    return out


def plan(histogram: dict[int, int], size: int, groups: int = 96, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, low, high, sequence, offset): ranks low to high - 1 of a length go to sequence + rank - low."""
    small = small or size // 4
    rows, sequence = [], 0
    if histogram.get(size):
        rows.append((size, 0, histogram[size], 0, 0))
        sequence = histogram[size]
    large = {x: n for x, n in histogram.items() if small <= x < size and n}
    total = sum(large.values())
    share = max(1, -(-total // groups))
    lengths = sorted(large, reverse=True)
    ends = np.cumsum([large[x] for x in lengths]) if lengths else np.empty(0, int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # left over: runs (sequence, how many)
    for often, slots in configurations(large, size, groups, small):
        at = 0
        while at < often:
            real, run = [], often - at
            for _, first, g in slots:
                rank = g * share + first + at
                x = int(np.searchsorted(ends, rank, "right"))
                real.append((lengths[x], rank - (int(ends[x - 1]) if x else 0)))
                run = min(run, int(ends[x]) - rank)
            offset = 0
            for length, rank in real:
                rows.append((length, rank, rank + run, sequence, offset))
                offset += length
            room[size - offset].append((sequence, run))
            sequence += run
            at += run
    for length in sorted((x for x in histogram if x < small and histogram[x]), reverse=True):
        at = 0
        while at < histogram[length]:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            first, run = room[fit].pop() if fit is not None else (sequence, -(-(histogram[length] - at) // (size // length)))
            if fit is None:
                sequence, fit = sequence + run, size
            n = min(run, histogram[length] - at)
            if n < run:
                room[fit].append((first + n, run - n))
            rows.append((length, at, at + n, first, size - fit))
            room[fit - length].append((first, n))
            at += n
    return rows


def sequences(rows: list[tuple[int, int, int, int, int]]) -> int:
    return max((s + high - low for _, low, high, s, _ in rows), default=0)


def best_plan(histogram: dict[int, int], size: int, groups: int = 96) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences, by which lengths are grouped: from a quarter of the size on, from an eighth, a
    third or a half, or none, which is best fit decreasing alone. Of equal plans the first."""
    return min((plan(histogram, size, groups, small) for small in (size // 4, size // 8, size // 3, size // 2, size)), key=sequences)


def packed(docs: DataFrame, tokenizer: str, size: int = 1024, end: int | None = 2, groups: int = 96, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0), and ids if asked.

    Null and empty texts are the end token alone, or no piece where end is None. Repeated rows and doc_ids are packed
    as often as they stand; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, tokenizer, size, end, with_ids), "pieces")
    counts = stored(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = spark.createDataFrame(best_plan(histogram, size, groups), "length long, low long, high long, sequence long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    ranked = rows.join(small_or_shuffled(before.select("length", "part", "before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    here = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    found = ranked.alias("r").join(F.broadcast(places.alias("p")), here)  # runs of the plan: bounded by size and groups, not by the corpus
    more = ["r.ids"] if with_ids else []
    return found.select("r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("p.offset").alias("offset"), *more)
