import hashlib
import random
import struct
import wave
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockmill.llm import chunk_store, media, token_files
from blockmill.llm.chunk_store import Cutting
from tests.llm.fixtures import documents, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shared_texts(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = " ".join(rng.choice(words) for _ in range(4000))
    return [(300, base, "en", "a", 0), (301, base, "en", "a", 0), (302, "new start " + base, "en", "a", 0), (303, base[:9000] + " cut in " + base[9000:], "en", "a", 0)]


def test_token_store(spark):
    docs = documents(spark, shared_texts())
    path, kind = token_files.write_tokens(docs, PATH)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, path, kind).collect())
    library = Tokenizer.from_file(PATH)
    rows = [(-1 if r.doc_id is None else r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")) for r in docs.collect()]
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((d, len(i), zlib.crc32(i.tobytes())) for d, i in rows)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda x: x[1]):
        assert start == at
        at += n
    assert [d for d, *_ in sorted(got, key=lambda x: x[1])] == sorted(d for d, *_ in got)
    files = spark.read.parquet(f"{path}/recipes").selectExpr("input_file_name() AS f", "coalesce(doc_id, -1) AS d").collect()
    assert [r.d for r in sorted(files, key=lambda r: (r.f, r.d))] == sorted(r.d for r in files)
    ids = {r.doc_id: r.ids for r in token_files.tokens_of(spark, path, kind).collect()}
    assert all(bytes(ids[d]) == i.tobytes() for d, i in rows if d > 8)


def test_chunks_are_stored_once(spark):
    path, _ = token_files.write_tokens(documents(spark, shared_texts()), PATH)
    rows, chunks = spark.read.parquet(f"{path}/recipes").collect(), spark.read.parquet(f"{path}/chunks").collect()
    kept = [bytes(r.name) for r in chunks] + [bytes(n) for r in rows for n, h in zip(r.names, r.held) if h]
    assert len(kept) == len(set(kept)) and set(kept) == {bytes(n) for r in rows for n in r.names}
    assert any(not all(r.held) for r in rows)


def test_a_wrong_chunk_fails_the_read(spark, tmp_path):
    path, kind = token_files.write_tokens(documents(spark, shared_texts()), PATH)
    bad = str(tmp_path / "bad")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{bad}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    spark.createDataFrame([(c.name, chunks[0].chunk) for c in chunks], "name binary, chunk binary").write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="don't match"):
        token_files.read_tokens(spark, bad, kind).collect()


def test_media(spark):
    docs = documents(spark, shared_texts())
    rows = media.read_media(spark, media.write_media(docs)).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id or -1, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 44 + len(padded), hashlib.sha256(media.wave_head(len(padded)) + padded).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(want)
    assert len({r.feature for r in rows if r.doc_id in (7, 8)}) == 1
    w = wave.open(io.BytesIO(media.wave_head(128) + bytes(range(128))))
    assert (w.getnframes(), w.getsampwidth(), w.readframes(128)) == (128, 1, bytes(range(128)))
    assert struct.unpack("<I", media.wave_head(128)[4:8])[0] == 36 + 128


def test_no_rows(spark):
    path, kind = token_files.write_tokens(nothing(spark), PATH)
    assert token_files.read_tokens(spark, path, kind).count() == 0
    assert media.read_media(spark, media.write_media(nothing(spark))).count() == 0


def test_cuts_move_with_content():
    rng = np.random.default_rng(3)
    c, x = Cutting(window=16, bits=6, least=32, most=400), rng.integers(0, 256, 20_000).astype(np.uint8)
    ends = c.cuts(x)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(x) and sizes.max() <= 400 and sizes[:-1].min() >= 32
    names = lambda units: {bytes(units[s:e]) for s, e in zip([0, *c.cuts(units)], c.cuts(units))}
    shifted = np.concatenate([x[:100], np.array([7, 7, 7], np.uint8), x[100:]])
    assert len(names(x) & names(shifted)) > 0.9 * len(names(x))
    assert c.cuts(x[:0]) == [] and c.cuts(x[:5]) == [5]
    assert Cutting(bits=20, least=4, most=10).cuts(np.zeros(25, np.uint8)) [-1] == 25


def test_merkle_root():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    h = lambda x: hashlib.sha256(x).digest()
    assert chunk_store.merkle_root([a]) == a and chunk_store.merkle_root([a, b, c]) == h(h(a + b) + c)
