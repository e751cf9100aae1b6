import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockmill.llm import packing
from blockmill.llm.tokens import WordEncoder
from tests.llm.fixtures import documents, nothing

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]


@pytest.mark.parametrize("path", PATHS)
def test_ids_equal_the_librarys(path):
    rng = random.Random(1)
    letters = "aB1é.,'|% \n\t!sÉ́ ßΣİ中K\r\x0b\x1c\x85 -\"<|>jJ"
    texts = ["", " ", "\n", "  a  b", "Don't STOP.'s x", "J̌ é X̸", "<|endoftext|> <|startoftext|>", "a<|endoftext|>b <|EndOfText|>.<|STARTOFTEXT|>", "a   b", "x" * 5000, "w " * 3000, "\0 \0a", "﻿a b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [rng.choice(texts) + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>"]) + rng.choice(texts) for _ in range(300)]
    encoder, library = WordEncoder(path), Tokenizer.from_file(path)
    for batch in (texts, texts[::-1], [], [""], ["", "", "a"]):
        got = encoder.encode(batch)
        want = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
        assert [g.tolist() for g in got] == want


def test_memo_is_bounded(monkeypatch):
    from blockmill.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    encoder, library = WordEncoder(PATHS[0]), Tokenizer.from_file(PATHS[0])
    for k in range(5):
        texts = [f"w{k}a{i} and w{i}" for i in range(40)]
        assert [g.tolist() for g in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.sizes) <= 300


def best_fill(left, room):
    """The fullest multiset by trying all."""
    sums = {0}
    for n, c in left.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    return max(sums)


def test_patterns_are_the_fullest():
    rng = random.Random(2)
    for _ in range(60):
        window = rng.randrange(10, 80)
        left = {rng.randrange(1, window + 1): rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))}
        want = dict(left)
        for times, used in packing.slack_patterns(left, window):
            first = max(want)
            rest = {n: c - (n == first) for n, c in want.items()}
            assert sum(n * c for n, c in used.items()) == first + best_fill({n: c for n, c in rest.items() if c}, window - first)
            for n, c in used.items():
                want[n] -= times * c
                assert want[n] >= 0
            want = {n: c for n, c in want.items() if c}
        assert not want
    with pytest.raises(ValueError):
        packing.slack_patterns({11: 1}, 10)
    assert packing.slack_patterns({}, 10) == []


def test_every_id_in_one_place(spark):
    docs = documents(spark, [(200 + i, "w " * (i % 7), "en", "a", 0) for i in range(60)])
    rows = packing.pack_documents(docs, PATHS[0], end_id=2, window=64).collect()
    library = Tokenizer.from_file(PATHS[0])
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.setdefault(r.doc_id, []).append(np.array(ids, "<u4"))
    seen, places = {}, {}
    for r in rows:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: sum(map(len, v)) for k, v in want.items()}
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(seen.values()) / (64 * len(places)) > 0.95


def test_a_hot_length_in_ranges(spark):
    pieces = spark.range(5000).selectExpr("id AS piece_id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id % 90 + 1 END AS length", "'x' AS `_n`", "id AS `_begin`")
    rows = packing.pack(pieces, window=100, pieces_per_range=50).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len({r.piece_id for r in rows}) == 5000
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert p == (o + n if s == t else 0)


def test_no_rows(spark):
    assert packing.pack_documents(nothing(spark), PATHS[0], end_id=2).count() == 0
