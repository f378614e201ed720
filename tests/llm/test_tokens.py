import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import cutting_stock, packing, token_files
from riskframe.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab'st \t\n\x1c\xa0²ΣİÉé́_0٣<|")),
               max_size=40))
def test_encoder_equals_the_library(text):
    assert encoder(PATH).encode(text).tolist() == ids_of(text)


def test_encoder_batches_and_full_memo(documents, monkeypatch):
    texts = [r["text"] or "" for r in documents.collect()]
    own = Encoder(PATH)
    monkeypatch.setattr("riskframe.llm.tokens.CHARS_A_TIME", 900)
    monkeypatch.setattr("riskframe.llm.tokens.WORDS_KEPT", 50)
    assert [x.tolist() for x in own.encode_many([*texts[:40], "", " a ", "<|endoftext|>"])] == [
        ids_of(t) for t in [*texts[:40], "", " a ", "<|endoftext|>"]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_packing_keeps_every_token_once(request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack(df, PATH).collect()
    want = sorted([*ids_of(r["text"]), 2] for r in df.collect())
    # pieces of one document, put together again
    docs, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(len(i) for ps in docs.values() for _, i in ps) == sum(map(len, want))
    assert sorted(i for ps in docs.values() for _, p in ps for i in p) == sorted(i for w in want for i in w)
    for spans in seqs.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    assert sorted(seqs) == list(range(len(seqs)))


def test_long_document_pieces_follow_each_other(odd_documents):
    text = odd_documents.where("doc_id = 13").first()["text"]
    rows = sorted((r["start"], r["length"], bytes(r["ids"])) for r in packing.pack(
        odd_documents.where("doc_id = 13"), PATH).collect())
    assert np.frombuffer(b"".join(r[2] for r in rows), "<u2").tolist() == [*ids_of(text), 2]
    assert [r[0] for r in rows] == list(range(0, len(ids_of(text)) + 1, 4096))


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.unique(np.clip(rng.lognormal(4.2, 0.8, 400).astype(int), 1, 512))
    counts = rng.integers(1, 400, len(sizes))
    plan = cutting_stock.plan(dict(zip(sizes.tolist(), counts.tolist())), 512)
    held = {}
    for pattern, uses in plan:
        assert (pattern[:, 0] * pattern[:, 1]).sum() <= 512 and uses > 0
        for s, n in pattern.tolist():
            held[s] = held.get(s, 0) + n * uses
    assert held == dict(zip(sizes.tolist(), counts.tolist()))
    least = -(-int((sizes * counts).sum()) // 512)
    assert sum(u for _, u in plan) <= 1.01 * least + 2


def test_column_generation_small_cases():
    assert cutting_stock.plan({}, 512) == []
    assert sum(u for _, u in cutting_stock.plan({512: 3}, 512)) == 3
    assert sum(u for _, u in cutting_stock.plan({300: 4, 212: 4}, 512)) == 4
    assert sum(u for _, u in cutting_stock.plan({1: 1000}, 512)) == 2
    pattern, value = cutting_stock.best_pattern(np.array([3, 5]), np.array([3.0, 6.0]), 11)
    assert value == 12 and pattern.tolist() == [0, 2]


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_token_files_read_back(request, which):
    df = request.getfixturevalue(which)
    manifest = token_files.write_token_files(df, PATH, length=64)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    want = sorted(((r["doc_id"], [*ids_of(r["text"]), 1]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(
        ((i, len(x), crc(x)) for i, x in want), key=key)


def test_token_files_give_sequences_and_masks_without_copies(documents):
    for row in token_files.write_token_files(documents.where("doc_id < 40"), PATH, length=32).collect():
        before = pa.total_allocated_bytes()
        reader = token_files.open_file(row["seq_path"])
        batch = reader.get_batch(reader.num_record_batches - 1)
        assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 32)
        ids, mask = batch.column("ids"), batch.column("mask")
        assert pa.total_allocated_bytes() - before < 10_000       # views of the mapped file
        pad = (~np.array(mask.values.to_pylist())).sum()
        assert pad == -row["n_tokens"] % 32 and len(ids) == len(mask)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(docs, PATH)).count() == 0


def test_ids_of_documents_ascend_over_files(documents):
    manifest = token_files.write_token_files(documents, PATH).orderBy("part")
    last = -1
    for row in manifest.collect():
        ids = token_files.open_file(row["doc_path"]).read_all().column("doc_id").to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    assert manifest.agg(F.sum("n_docs")).first()[0] == documents.count()
