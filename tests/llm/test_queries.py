"""The ten queries on the smallest tables: their columns and types, and their SQL where there is any."""

import zlib

import duckdb
import numpy as np
import pytest

from relspark.llm import queries as q

DIR = "/root/testdata/sf0.001"
#: The columns that the contracts name.
COLUMNS = {
    "op1_": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_": "doc_id bigint, shard string, shard_rows bigint, shard_bytes bigint, version bigint",
    "op4_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_aligned bigint",
    "op6_": "capture_id bigint, host string, day int, n_active bigint, matches string, blocked boolean",
    "op7_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, has_repeats boolean",
    "op9_": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(q.queries()))
def test_query(spark, db, name):
    df = q.queries()[name](spark, DIR)
    want = next(v for k, v in COLUMNS.items() if name.startswith(k))
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == want
    rows = df.collect()
    ids = [r[0] for r in db.execute("SELECT doc_id FROM documents" if name != "op6_url_filters" else "SELECT page_id FROM pages").fetchall()]
    assert {r[0] for r in rows} == set(ids) and (len(rows) == len(ids) or name.startswith("op7_"))
    if name in q.oracle_sql():
        found = db.execute(q.oracle_sql()[name])
        at = [[c[0] for c in found.description].index(c) for c in df.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
    if name.startswith("op4_"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
        truth = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
        assert np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows if r.doc_id in truth]) > 0.9
    if name.startswith("op10_"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    if name.startswith("op5_"):
        assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
