"""The pipeline's stages against plain versions of their decisions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from blockmill.llm import quality, toxicity
from tests.llm.fixtures import documents, nothing
from tests.llm.test_classifiers import LABELS, corpus
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels = corpus(260, seed=4)
    rng = random.Random(9)
    for i, (_, text, *_) in enumerate(docs[:25]):
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((3000 + i, " ".join(words) if i % 2 else text, "en", "b", 0))
    folder = tmp_path_factory.mktemp("sf")
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    rows = lambda df: sorted(((r.doc_id, r.text, r["size"], r["_rest"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    clean = stages["toxicity"](spark, docs, sf_dir)
    model = toxicity.fit_toxicity(docs, labels)
    assert clean.columns == docs.columns
    assert rows(clean) == [(r.doc_id, r.text, r["size"], r["_rest"]) for r in sorted(docs.collect(), key=key) if model.score(model.sentences(r.text or "")) < 0.3]
    assert clean.count() < docs.count()

    good = stages["quality"](spark, clean, sf_dir)
    fitted = quality.fit_quality(clean, labels)
    x, of = quality.passage_features([r.text for r in sorted(clean.collect(), key=key)])
    y = fitted.forward(x, of, clean.count())["y"]
    assert rows(good) == [r for r, p in zip(rows(clean), y) if p >= 0.5]
    assert good.columns == docs.columns and good.count() < clean.count()

    one = stages["near_copies"](spark, good, sf_dir)
    named = [(r.doc_id, r.text) for r in good.collect() if r.doc_id is not None]
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({c for _, _, c in brute(named, 5, 80)})
    assert one.columns == docs.columns and one.count() < good.count()

    mixed = stages["mixing"](spark, one, sf_dir)
    size = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert mixed.columns == docs.columns and size(mixed) == pytest.approx(1.5 * size(one), abs=20)
    ids = {r.doc_id: set((r.text or "").split()) for r in one.collect()}
    assert all(set(r.text.split()) <= ids[r.doc_id] for r in mixed.collect())

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,) for r in mixed.collect())
    sequences = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and len(sequences.setdefault(r.sequence_id, [])) == r.offset
        sequences[r.sequence_id] += ids
    short = [tuple(sequences[r.sequence_id][r.offset : r.offset + r.length]) for r in packed if r.doc_tokens == r.length]
    assert sorted(short) == [w for w in want if len(w) <= 4096] and sum(r.length for r in packed) == sum(map(len, want))
    assert library.decode(short[0][:-1]) == library.decode([i for i in short[0] if i != 2])


def test_repeated_ids_with_other_texts(spark):
    rows = [(3, "a text of one kind"), (5, "a text of one kind"), (5, "B b b"), (5, "b  B b"), (5, "b  B b"), (9, "and yet another"), (None, "a text of one kind"), (None, "z z"), (None, "z Z"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_copy(spark, docs, "").collect()
    got = sorted(((r.doc_id, (r.text or "").lower().replace("  ", " ")) for r in kept), key=repr)
    assert got == sorted([(3, rows[0][1]), (5, "b b b"), (9, rows[5][1]), (None, "z z"), (None, ""), (7, "")], key=repr)


def test_run(spark, sf_dir):
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect() if r.doc_id is not None) for _ in range(2))
    assert a == b and len(a) > 100


def test_stages_of_nothing(spark, sf_dir):
    docs = nothing(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name
    assert zlib.crc32(b"") == 0
