import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe
from factloom.llm.queries import op4_bpe, vocabulary

WHOLE = Tokenizer.from_file(vocabulary())
CODEC = bpe.codec(vocabulary())
BITS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "é", "à", "ß", "中", "\x1c", "\x85", "0", "12", "½", "<|endoftext|>", "<|endof", "😀", "́", "\r", "\xa0", "​", "_", "Ⅷ", "\x00", "٣", "　", " ", " ", "qx", "''", "!'s"]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(BITS), max_size=16).map("".join), st.text(max_size=60)))
def test_same_as_encoding_the_whole(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ids
    assert CODEC.decode(CODEC.encode(text)) == WHOLE.decode(ids, skip_special_tokens=False)


def test_forced_pairs_are_those_of_the_vocabulary():
    inside = {(a, b) for i, t in CODEC.bytes_of.items() if t.decode("utf-8", "replace") != "<|endoftext|>" for a, b in zip(t, t[1:])}
    assert {(a, b) for a in range(256) for b in range(256) if not CODEC.forced[a, b]} == inside


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_texts_are_cut_at_forced_pairs(sf_dir):
    """Every cut is between a forced pair, and there are more of them than words; the ids agree with the library."""
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    cuts = words = 0
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        at = CODEC.cuts(data)
        assert CODEC.forced[data[at - 1], data[at]].all()
        edges = [0, *at.tolist(), len(data)]
        parts = [data[s:e].tobytes() for s, e in zip(edges, edges[1:])]
        ids = WHOLE.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(map(CODEC.fragment, parts)), "<u4").tolist() == ids
        cuts, words = cuts + len(at), words + len(text.split())
    assert cuts > words, (cuts, words)


def test_rows_of_one_buffer_do_not_meet():
    rows = ["a", "", " b<|endoftext|>", "<|endof", "text|> c", "<|endoftext|><|endoftext|>", "'s", "  ", "x"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, rows)])
    assert [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode_rows(data, offs)] == [e.ids for e in WHOLE.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 1_000_000, "ab " * 50_000, "\n " * 20_000, "é" * 300_000, "'" * 300_000, "<|endoftext|>" * 50_000])
def test_long_texts(text):
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_query_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    rows = op4_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = WHOLE.encode(docs.text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs.text[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens int")
    rows = bpe.bpe_digests(docs, vocabulary()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 0), ("2", 2), ("2", 2), ("None", 0)]
    back = bpe.decode_column(bpe.encode_column(docs, vocabulary()), vocabulary()).collect()
    assert sorted((r.text or "") == r.decoded for r in back) == [True] * 4
    assert bpe.bpe_digests(docs.limit(0), vocabulary()).count() == 0
