"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

The sketch of a set has T coordinates. In round i each element is hashed to a bin and a value; a bin keeps the least
value of the first round that reaches it. Rounds T to 2T-1 send every element to one fixed bin each, so that every
coordinate is filled. Two sets agree in a coordinate with a probability of their Jaccard similarity, with the
concentration of independent hashes.

Scale: texts with the same words are one class before anything is compared. Bands put classes in buckets; a bucket of
m classes gives m-1 pairs with its least class, not m*m, and connected ones leave the next round, in which only pairs
of different components are left. Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches, release, small_or_shuffled, stored, text_of
from .words import GOLD, M1, M2, grouped, mix, places, plain, scanned

#: 32 bands of 4 coordinates: a pair with a similarity of 0.8 shares none with a probability of (1 - 0.8^4)^32 < 5e-8.
BANDS, ROWS = 32, 4
T = BANDS * ROWS
def shingled(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many) of the distinct runs of width words of texts of n words with hashes h, sorted within each text.

    With fewer words, all of them are one run; without words there is none.
    """
    first, size = np.cumsum(n) - n, np.maximum(n - width + 1, np.minimum(n, 1))
    start = np.repeat(first, size) + places(size)
    out = np.repeat(np.minimum(n, width), size).astype(np.uint64)
    short = np.repeat(n, size) < width
    for i in range(width):
        if short.any():
            on = i < np.repeat(n, size)
            out[on] = mix(out[on] + h[start[on] + i] + GOLD)
        else:
            out = mix(out + h[start + i] + GOLD)
    bounds = np.cumsum(size)
    for a, z in zip((bounds - size).tolist(), bounds.tolist(), strict=True):
        out[a:z].sort()
    new = np.append(True, out[1:] != out[:-1])[: len(out)]
    new[(bounds - size)[size > 0]] = True
    return out[new], np.diff(np.concatenate(([0], np.cumsum(new)))[np.concatenate(([0], bounds))])


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    raw, out = [t.encode("utf-8", "surrogatepass") for t in texts], []
    for part in grouped(raw):
        n, (h,) = scanned(raw[part], plain)
        s, size = shingled(h, n, width)
        out += np.split(s, np.cumsum(size)[:-1])
    return out


def _keys(h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """16 bytes that name the sequence of words of each text; null without words."""
    if not len(h):
        return [None] * len(n)
    at, first = places(n).astype(np.uint64) * GOLD, (np.cumsum(n) - n)[n > 0]
    both = np.stack([np.add.reduceat(mix(mix(h * odd + at) + odd), first) for odd in (M1, M2)], 1)
    named = iter(both.view("V16").ravel().tolist())
    return [next(named) if k else None for k in n.tolist()]


def text_keys(texts: list[str]) -> list[bytes | None]:
    raw, out = [t.encode("utf-8", "surrogatepass") for t in texts], []
    for part in grouped(raw):
        n, (h,) = scanned(raw[part], plain)
        out += _keys(h, n)
    return out


def sketches(elements: np.ndarray, size: np.ndarray) -> np.ndarray:
    """T coordinates of each of consecutive sets of hashes, none of them empty. The round is in the top bits, so the least
    value is of the first round; a set whose coordinates are all filled takes part in no further one."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, own = np.full(len(size) * T, top, np.uint64), np.repeat(np.arange(len(size)) * T, size)
    for r in range(2 * T):
        h = mix(elements + mix(np.array([r], np.uint64) + GOLD))
        bins = (h & np.uint64(T - 1)).astype(np.int64) if r < T else r % T
        np.minimum.at(out, own + bins, np.uint64(r << 52) | (h >> np.uint64(12)))
        if r < 4 or r % 4 == 3:
            left = (out.reshape(-1, T) == top).any(1)
            if not left.any():
                break
            on = left[own // T]
            elements, own = elements[on], own[on]
    return out.reshape(-1, T)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """BANDS keys of each line of coordinates."""
    parts, key = coordinates.reshape(-1, BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[None, :]
    for i in range(ROWS):
        key = mix(key * GOLD + parts[:, :, i] + np.uint64(i))
    return key.view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key: 16 bytes of the words' hash, null without words; n: set size; bands)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, keys, sizes, bands = b.column(1).cast(pa.binary()).to_pylist(), [], [], []
        for part in grouped(raw):
            n, (h,) = scanned(raw[part], plain)
            own = _keys(h, n)
            # texts with the same words are worked on once
            place: dict[bytes | None, int] = {}
            for i, k in enumerate(own):
                place.setdefault(k, i)
            once = np.fromiter(place.values(), np.int64, len(place))
            mask = np.zeros(len(n), bool)
            mask[once] = True
            s, size = shingled(h[np.repeat(mask, n)], n[mask], width)
            found = np.zeros((len(n), BANDS), np.int64)
            full = np.flatnonzero(mask)[size > 0]
            if len(full):
                found[full] = band_keys(sketches(s, size[size > 0]))
            count = np.zeros(len(n), np.int64)
            count[mask] = size
            at = np.array([place[k] for k in own])
            keys += own
            sizes.append(count[at])
            bands += [found[i] if k is not None else [] for i, k in zip(at, own, strict=True)]
        return pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n", "bands"])

    return batches(docs, run, "doc_id long, key binary, n long, bands array<long>")


def keyed_texts(docs: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """(key, text), one row for each wanted (doc_id, key)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(text_keys(b.column(1).to_pylist()), pa.binary()), b.column(1)], ["key", "text"])

    near = docs.join(small_or_shuffled(wanted.select("doc_id").distinct(), count), "doc_id", "left_semi")
    near = near.unionByName(docs.filter("doc_id is null"))  # no join finds these; the key below does
    found = batches(near, run, "key binary, text string").join(small_or_shuffled(wanted.select("key"), count), "key", "left_semi")
    return found.groupBy("key").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which the full shingle sets have 100 * intersection >= percent * union."""
    a, b = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        texts = dict(zip(cols[0] + cols[1], cols[2] + cols[3], strict=True))
        sets = dict(zip(texts, shingle_sets(list(texts.values()), width), strict=True))
        keep = []
        for ka, kb in zip(cols[0], cols[1], strict=True):
            x, y = sets[ka], sets[kb]
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return batches(rows, run, "a binary, b binary")


#: Edges that one task may join by itself.
FEW_EDGES = 20_000


def _joined(table: pa.Table) -> pa.Table:
    """(key, root: the least key that it is linked with) of all ends of edges (a, b)."""
    root: dict[bytes, bytes] = {}

    def find(k: bytes) -> bytes:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return pa.table([pa.array(list(root), pa.binary()), pa.array([find(k) for k in list(root)], pa.binary())], ["key", "root"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, comp) as a stored table: for each node, the least key that it is linked with. nodes (key), edges (a, b).

    Every node points to its least neighbour, if that is less than itself; pointers jump to their roots; edges between
    different roots are what the next level works on. A level at least halves the nodes, and stars, as buckets make
    them, are gone after one. A hot node's neighbours are reduced by partial aggregates. Once FEW_EDGES or fewer are
    left, one task joins them.
    """
    different = lambda df: df.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, found = stored(different(edges.select("a", "b")), "edges"), None
    while True:
        if edges.count() <= FEW_EDGES:
            up = edges.groupBy(F.lit(0).alias("one")).applyInArrow(_joined, "key binary, root binary")
            found = up.toDF("key", "comp") if found is None else found.join(up.toDF("comp", "root"), "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
            break
        both = edges.select(F.col("a").alias("key"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = stored(both.groupBy("key").agg(F.least(F.col("key"), F.min("other")).alias("root")), "roots")
        while True:
            far = up.select(F.col("key").alias("root"), F.col("root").alias("next"))
            jumped = stored(up.join(far, "root").select("key", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            release(up)
            up = jumped
            if up.filter("moved").isEmpty():
                break
        up = up.select("key", "root")
        ends = edges.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        rest = stored(different(ends), "edges")
        release(edges)
        level = up.toDF("comp", "root")
        found = up.toDF("key", "comp") if found is None else found.join(level, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
        if rest.isEmpty():
            break
        edges = rest
    return stored(nodes.join(found, "key", "left").select("key", F.coalesce("comp", "key").alias("comp")), "components")


#: Parts that the rows of a band are dealt to, where the bands are too many to be broadcast.
SALT = 32


def with_band(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows (band, key, ...) joined with bands, which has a row for each band; a band with many rows isn't one task's."""
    bands = stored(bands, "bands")
    n = bands.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(bands), "band")
    salted = bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).join(salted, ["band", "_salt"]).drop("_salt")


def able(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(band, key, n, comp, c), stored, of the rows (band, key, n, comp) that can still have a link outside their component.

    c counts the shingles that a row of another component has too. A link needs at least percent of n of them, so a
    near copy whose own edits exceed the rest is settled here, without pairs.
    """
    spread = members.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    members = with_band(members, spread.select("band"))
    nodes = members.select("key", "comp").distinct().join(texts, "key").select("key", "comp", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x.view(np.int64) for x in shingle_sets(b.column(2).to_pylist(), width)]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        return pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.concatenate(sets))], ["key", "comp", "shingle"])

    grams = stored(batches(nodes, run, "key binary, comp binary, shingle long"), "grams")
    shared = grams.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    common = grams.join(shared.select("shingle"), "shingle", "left_semi").groupBy("key").agg(F.count("*").alias("c"))
    out = stored(members.join(common, "key").filter(F.col("c") * 100 >= F.col("n") * percent), "able")
    release(grams)
    return out


def blockwise(nodes: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 128) -> DataFrame:
    """The links (a, b) between different components of a cluster. nodes (cluster, key, comp).

    A cluster is cut into blocks by hash, and each two blocks meet in one task, which counts common shingles by an
    inverted list and returns links only. No pair is made into a row.
    """
    count = nodes.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    count = count.filter("low != high").select("cluster", "blocks")
    placed = nodes.join(count, "cluster").join(texts, "key").withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    sides = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as i, greatest(own, o) as j))")
    dealt = placed.withColumn("side", F.explode(sides)).select("cluster", "side.i", "side.j", "own", "key", "comp", "text")

    def run(table: pa.Table) -> pa.Table:
        key, comp, own = (table.column(x).to_pylist() for x in ("key", "comp", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        names = {c: k for k, c in enumerate(sorted(set(comp)))}
        comps, owns = np.array([names[c] for c in comp]), np.array(own)
        sets = shingle_sets(table.column("text").to_pylist(), width)
        n = np.array([len(x) for x in sets])
        flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
        docs = np.repeat(np.arange(len(sets)), n)[np.argsort(ids, kind="stable")]
        starts = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(flat)))))
        at, a, b = np.concatenate(([0], np.cumsum(n))), [], []
        for x in range(len(sets)):
            if owns[x] == i:
                own_ids = ids[at[x] : at[x + 1]]
                common = np.bincount(np.concatenate([docs[starts[g] : starts[g + 1]] for g in own_ids]), minlength=len(sets))
                linked = ((100 + percent) * common >= percent * (n + n[x])) & (comps != comps[x]) & (owns == j) & ((i != j) | (np.arange(len(sets)) > x))
                for y in np.flatnonzero(linked):
                    a.append(min(key[x], key[y]))
                    b.append(max(key[x], key[y]))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a binary, b binary")


def _decided(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, lead): lead tells the rows of the component's least (doc_id, key)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = stored(sketched(docs, width), "sketches")
    classes = stored(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("key", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("m")).filter("m > 1")
    members = stored(banded.join(buckets, "band"), "members")
    pairs = stored(members.filter("key != least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    wanted = stored(members.select("key").distinct().join(classes.select("key", "doc_id"), "key"), "wanted")
    nodes = wanted.select("key")
    texts = stored(keyed_texts(docs, wanted, wanted.count()), "texts")
    links = stored(verified(pairs, texts, width, percent), "links")
    comps = components(nodes, links)
    # The buckets that still hold several components: first with the member that shares most, then in blocks.
    wide = stored(members.filter("m > 2").select("band", "key", "n").join(comps, "key"), "wide")
    alive = able(wide, texts, width, percent)
    if not alive.isEmpty():
        best = alive.groupBy("band").agg(F.max(F.struct(F.col("c") / F.col("n"), F.col("key"), F.col("comp"))).alias("lead"))
        more = with_band(alive, best).filter(F.col("comp") != F.col("lead.comp")).select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b"))
        nearer = stored(links.unionByName(verified(more.distinct().join(pairs, ["a", "b"], "left_anti"), texts, width, percent)), "links")
        release(links, comps)
        least = alive.groupBy("band").agg(F.min("key").alias("a"))
        tied = with_band(alive.select("band", "key"), least).select("a", F.col("key").alias("b")).distinct()
        comps, clusters = components(nodes, nearer), components(alive.select("key").distinct(), tied)
        rest = stored(alive.select("key").distinct().join(comps, "key").join(clusters.withColumnRenamed("comp", "cluster"), "key"), "rest")
        links = stored(nearer.unionByName(blockwise(rest, texts, width, percent)), "links")
        release(comps, nearer, rest, clusters)
        comps = components(nodes, links)
    release(alive, wide, links, texts, wanted, pairs, members)
    ids = classes.select("key", "doc_id").join(comps, "key", "left").select("key", "doc_id", F.coalesce("comp", "key").alias("comp"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("key").alias("lead_key"), F.col("doc_id").alias("component_id"))).alias("first")
    firsts = stored(ids.groupBy("comp").agg(first), "firsts")  # so that the join can split a large component
    labelled = ids.join(firsts, "comp").select("key", "first.lead_key", "first.component_id")
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(labelled, "key", "left")
    alone = F.col("key").isNull()
    lead = alone | ((F.col("key") == F.col("lead_key")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), lead.alias("lead"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Links join documents with 100 * |A and B| >= percent * |A or B| over distinct runs of width words. Null and
    empty texts have no shingles and no links. Rows with a null doc_id link others but name no component; they are
    kept only if no row of their component has a doc_id. Rows with one doc_id and several texts are separate
    documents; repeated rows stay repeated. Other columns are ignored; an empty table gives no rows.
    """
    out = _decided(docs, width, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, of which one stays for each component: that of the least doc_id, then words.

    Of repeated rows of it one stays. Texts without words have no copies and all stay.
    """
    found = stored(_decided(docs, width, percent), "decided")
    gone = found.filter("not lead").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("key").alias("_key")).distinct()
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array(text_keys([x or "" for x in b.column(at).to_pylist()]), pa.binary())
        return pa.record_batch([*b.columns, keys], [f"c{i}" for i in range(b.num_columns)] + ["_key"])

    keyed = batches(docs.toDF(*[f"c{i}" for i in range(len(names))]), run, schema + ", _key binary").withColumn("_id", F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(-1)))
    left = keyed.join(small_or_shuffled(gone), ["_id", "_key"], "left_anti")
    again = found.filter("lead and key is not null").groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_key")
    if n := again.count():
        again = small_or_shuffled(again, n)
        left = left.join(again, ["_id", "_key"], "left_anti").unionByName(left.join(again, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))
    return left.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)])
