"""Registered queries on the small tables, those with SQL against it."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from blockmill.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


#: The columns that each query must have, with their types.
CONTRACT = {
    1: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    2: "query_id bigint, rank int, vec_id bigint, score double",
    3: "doc_id bigint, held_out boolean, score double, predicted int",
    4: "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    5: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    6: "doc_id bigint, held_out boolean, score double, predicted int",
    10: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("n", sorted(CONTRACT))
def test_registered_query_keeps_its_contract(spark, n):
    """The query as it is registered, over a whole table: columns, types, and rules that hold for each row."""
    name = next(k for k in queries.queries() if k.startswith(f"op{n}_"))
    df = queries.queries()[name](spark, DATA)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert {c.split()[0]: types.get(c.split()[0]) for c in CONTRACT[n].split(", ")} == {c.split()[0]: c.split()[1] for c in CONTRACT[n].split(", ")}
    rows = df.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {3: (3, 1), 5: (7, 2), 6: (4, 2)}
    if n not in (2, 10):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if n in held:
        modulus, rest = held[n]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    if n in (3, 6):
        least = 0.5 if n == 3 else 0.3
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    if n == 5:
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
        assert all(r.n_tokens == len(words(docs[r.doc_id])) + 1 >= r.n_known and r.score < 0 for r in rows)
        assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    if n == 2:
        vectors = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
        assert {r.query_id for r in rows} == {v for v in vectors if v % 100 == 0} and len(rows) == 10 * len({r.query_id for r in rows})
    if n in (1, 10):
        library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json" if n == 1 else "word_bpe_49k.json"))
        ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0 if n == 1 else 2], "<u4") for d, t in docs.items()}
        for r in rows:
            own = ids[r.doc_id] if n == 1 else ids[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(own.tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == (r.n_tokens if n == 1 else r.doc_tokens)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
