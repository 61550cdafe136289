"""Byte pairs and packed ids against the tokenizers library."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldcheck.llm import bpe, pieces, tokenids
from fieldcheck.llm.queries import op4_token_ids, op8_bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "a \n b", "don't we'll", "\n\n x\n", " <|endoftext|> a<|endoftext|>b", "<|end", "aaaa aaaaaaa",
       "12 345,67 €$ $$$ a.\nBc", "日本 語　テ", "x y z w", "tab\tx \ty", "é è", "\x1c \x1d a", "a\r\n b", "'s 's don'T",
       "the." * 50, "😀😀 a", "\x85 a", "a !\n!b", "(a) [b]\n\nC", " ² 1²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.BytePairs(PATH)


def check(library, own, texts):
    arr = pa.array(texts, pa.string())
    pairs = pieces.Encoder(bpe.chunk_encoder(own), tuple(own.special))
    for encoder in (pairs, tokenids.library_encoder(PATH)):
        ids, at = encoder(arr)
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    ids, at = pairs(arr)
    for t, back in zip(texts, bpe.Pool(own.bytes_of).join(ids, at)):
        assert back.decode() == (t or "")


def test_odd_texts(library, own):
    check(library, own, [*ODD, None, " ".join(ODD), "\n".join(ODD)])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab Te.,<|endoftext|>\n\t' $1é語　 'sth"), max_size=30), max_size=6))
def test_random_texts(library, own, texts):
    check(library, own, texts)


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_round_trip(bits, values):
    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    data = np.concatenate([np.frombuffer(tokenids.pack(ids, bits), np.uint8), np.zeros(8, np.uint8)])
    assert len(data) - 8 == -(-len(ids) * bits // 8)
    assert tokenids.unpack(data, bits, np.arange(len(ids))).tolist() == ids.tolist()


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 9000, 5, 4096, 4095)]
    with open(tmp_path / "x", "wb") as f:
        w = tokenids.Writer(f, 17)
        w.add([5, 6], [len(d) for d in docs[:2]], np.concatenate(docs[:2]))
        w.add([7, 8, 9, 10], [len(d) for d in docs[2:]], np.concatenate(docs[2:]))
        w.close()
    r = tokenids.Reader((tmp_path / "x").read_bytes())
    assert r.doc_id.tolist() == [5, 6, 7, 8, 9, 10]
    for i, d in enumerate(docs):
        assert r.document(i).tolist() == d.tolist()
    flat = np.concatenate(docs)
    assert r.ids(8999, 300).tolist() == flat[8999:9299].tolist()


def test_op4(spark, library):
    rows = {r.doc_id: r for r in op4_token_ids(spark, SF).collect()}
    at = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_op8(spark, library):
    rows = {r.doc_id: r for r in op8_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    rows = [(3, "b"), (1, None), (1, "a a"), (1, "a a"), (None, "x"), (2, "long " * 30000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    out = tokenids.token_files(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 1, 1, 2, 3] and len(out) == 6
    assert sum(r.n_tokens for r in out) == out[-1].start + out[-1].n_tokens
    assert bpe.encode_decode(df, PATH).count() == 6
    assert tokenids.token_files(df.limit(0), PATH).count() == 0
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
    back = bpe.token_column(df, PATH).collect()
    assert [(r.doc_id, r.text) for r in back] == rows and back[1].token_ids == []
