"""The pipeline's stages on small tables against plain Python, and from end to end."""

import itertools
import random
import re

import pytest

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**5)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    bench = [prose(15, 900 + k) for k in range(3)]
    texts = {k: prose(80, k) for k in range(40)}
    texts |= {k: " ".join(f"{w}###" for w in prose(30, k).split()) for k in range(40, 60)}
    texts |= {60: texts[3], 61: texts[3].upper(), 62: texts[4] + " tail", 63: f"{texts[5][:200]} {bench[1]} more {prose(20, 5000)}", 64: f"{prose(30, 64)} token = 'Zx81kQpL0s2mN' end", 65: None, 66: "", 67: prose(900, 67)}
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in texts.items()] + [(None, prose(40, 70), None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts


def test_stages(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    good = P.quality(spark, docs, at)
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.collect()}
    assert set(range(40)) <= left and not left & set(range(40, 60))
    once = P.near_dedup(spark, docs, at)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == (set(texts) | {None}) - {60, 61, 62}
    clean = P.decontamination(spark, docs, at)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == (set(texts) | {None}) - {63}
    safe = {r.doc_id: r for r in P.secrets(spark, docs, at).collect()}
    assert safe[64].text == f"{prose(30, 64)} [REDACTED]' end" and safe[64].n_chars == len(safe[64].text)
    assert all(r.text == texts[i] for i, r in safe.items() if i not in (64, None))
    pieces = P.packing(spark, docs, at).collect()
    assert {r.doc_id for r in pieces} == set(texts) | {None} and max(r.length for r in pieces) <= 1024


def test_run(spark, folder):
    at, texts = folder
    rows = P.run(spark, at).collect()
    ids = {r.doc_id for r in rows}
    assert set(range(40)) | {64, 67, None} <= ids and not ids & {60, 61, 62, 63, *range(40, 60)}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_stages_take_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert P.quality(spark, docs, f"file://{tmp_path}").count() == docs.count() == P.decontamination(spark, docs, f"file://{tmp_path}").count()


def test_stage_list():
    assert [f.__name__ for _, f in P.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"] and P.ORACLE_SQL is None


SF = "/root/testdata/sf0.001"


def low(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages_equal_brute_force_on_the_tables(spark, tmp_path):
    """Each stage on all that the one before kept of the smallest tables, against plain Python."""
    kept = lambda df, name: (df.write.parquet(f"file://{tmp_path}/{name}"), spark.read.parquet(f"file://{tmp_path}/{name}"))[1]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = kept(P.quality(spark, docs, SF), "good")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    right = [(i in ids) == (q == 1) for i, q in labels.items()]
    assert sum(right) > 0.95 * len(right) and all(i in ids for i, q in labels.items() if q == 1)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    sets = []
    for _, t in rows:
        w = low(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    once = kept(P.near_dedup(spark, good, SF), "once")
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(ds) for ds in least.values()) and len(least) < len(rows)

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text, word)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = low(text, word)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    clean = kept(P.decontamination(spark, once, SF), "clean")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in once.collect() if not hit(r.text))

    base = [(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    found = lambda t: [m for p, g, n in base for m in re.finditer(p, t) if len(m[g]) >= n]
    safe = kept(P.secrets(spark, clean, SF), "safe")
    before = {r.doc_id: r.text or "" for r in clean.collect()}
    after = {r.doc_id: r.text or "" for r in safe.collect()}
    assert before.keys() == after.keys() and any(found(t) for t in before.values())
    for i, t in before.items():
        if found(t):
            assert "[REDACTED]" in after[i] and all(m[0] not in after[i] for m in found(t))
        elif "[REDACTED]" not in after[i]:
            assert after[i] == t

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    pieces = P.packing(spark, safe, SF).collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    lengths = sorted((r.length for r in pieces), reverse=True)
    room = []  # best fit decreasing
    for n in lengths:
        fit = min((x for x in range(len(room)) if room[x] >= n), key=lambda x: room[x], default=None)
        if fit is None:
            room.append(1024 - n)
        else:
            room[fit] -= n
    assert len({r.sequence_id for r in pieces}) <= len(room)
